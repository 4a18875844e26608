"""URL handling: normalisation, resolution, canonical crawl form, host rules.

``*_py`` functions run on executors inside the page parser; the column functions cover plain http URLs.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track.
TRACKING = ("gclid", "fbclid", "msclkid")
_PORTS = {"http": 80, "https": 443}
_HAS_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z\d+\-.]*://")


class UrlError(ValueError):
    """The input is not a usable http(s) URL."""


def _tidy(url: str) -> str:
    try:
        p = urlsplit(url)
        port = p.port
    except ValueError as e:
        raise UrlError(str(e)) from e
    scheme = p.scheme.lower()
    if scheme not in _PORTS:
        raise UrlError("Only HTTP and HTTPS URLs are supported")
    host = (p.hostname or "").rstrip()
    if not host or re.search(r"[\s<>^|%\\]", host):
        raise UrlError("Invalid host")
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError as e:
        raise UrlError("Invalid host") from e
    netloc = (f"[{host}]" if ":" in host else host) + (f":{port}" if port and port != _PORTS[scheme] else "")
    path = quote(_dots(p.path) or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
    return urlunsplit((scheme, netloc, path, quote(p.query, safe="/%:@!$&()*+,;=~-._?[]|^`{}\\"), ""))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, s in enumerate(parts):
        if s == "..":
            if len(out) > 1:
                out.pop()
        elif s != ".":
            out.append(s)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/".join(out)


def normalize_py(text: str) -> str:
    """Trimmed, https where no scheme is given, http(s) only, lower-case scheme and host, no fragment."""
    t = (text or "").strip()
    if not t:
        raise UrlError("URL is required")
    return _tidy(t if _HAS_SCHEME.match(t) else "https://" + t)


def resolve_py(base: str, href: str) -> str | None:
    """An href against a page, without fragment; null unless it is http(s)."""
    try:
        return _tidy(urljoin(base, href.strip()))
    except (UrlError, ValueError):
        return None


def canonical_py(url: str, base: str | None = None) -> str:
    """The crawl's key for a URL: no fragment or tracking parameters, parameters sorted by name (stable)."""
    full = _tidy(urljoin(base, url) if base else url)
    p = urlsplit(full)
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING)]
    kept.sort(key=lambda kv: kv[0])
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode(kept), ""))


def host(url: Column) -> Column:
    """Lower-case host without port."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _no_default_port(place: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(place, "^(https://.*):443$", "$1"), "^(http://.*):80$", "$1")


def origin(url: Column) -> Column:
    return _no_default_port(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)", 1)))


def path_and_query(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def canonical(url: Column) -> Column:
    """``canonical_py`` for URLs whose parameters need no re-encoding, as an expression."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_replace(bare, "\\?.*$", ""), F.regexp_extract(bare, "\\?(.*)$", 1)
    place = _no_default_port(F.lower(F.regexp_extract(head, "^([A-Za-z]+://[^/]+)", 1)))
    path = F.regexp_replace(head, "^[A-Za-z]+://[^/]+", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)"))
    ranked = F.transform(kept, lambda p, i: F.struct(F.regexp_replace(p, "=.*$", "").alias("k"), i.alias("i"), p.alias("p")))
    joined = F.array_join(F.transform(F.array_sort(ranked), lambda x: x["p"]), "&")
    return F.concat(place, F.when(path == "", F.lit("/")).otherwise(path), F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


# IPv4 ranges that are not public, and the IPv6 range of global unicast with its exceptions.
V4_PRIVATE = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
V6_PRIVATE = "2001::/23 2001:db8::/32 2002::/16 3fff::/20 5f00::/16".split()


def is_public_address(text: str) -> bool:
    """Whether an IP literal is publicly routable; mapped and translated IPv4 is judged by its IPv4 address."""
    try:
        ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
    except ValueError:
        return False
    if ip.version == 4:
        return not any(ip in ipaddress.ip_network(n) for n in V4_PRIVATE)
    inner = ip.ipv4_mapped
    if ip in ipaddress.ip_network("64:ff9b::/96"):
        inner = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
    if ip in ipaddress.ip_network("2002::/16"):
        inner = ipaddress.IPv4Address((int(ip) >> 80) & 0xFFFFFFFF)
    if inner is not None:
        return is_public_address(str(inner))
    return ip in ipaddress.ip_network("2000::/3") and not any(ip in ipaddress.ip_network(n) for n in V6_PRIVATE)


def is_public_v4(address: Column) -> Column:
    """The IPv4 rule as an expression over dotted text: null-safe, false for anything else."""
    octets = F.regexp_extract_all(address, F.lit("(\\d{1,3})"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    bad = F.lit(False)
    for n in V4_PRIVATE:
        net = ipaddress.ip_network(n)
        bad = bad | number.between(int(net.network_address), int(net.broadcast_address))
    ok = address.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$") & F.forall(octets, lambda x: x.cast("int") <= 255)
    return F.coalesce(ok & ~bad, F.lit(False))
