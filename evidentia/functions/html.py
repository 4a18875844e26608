"""Page parsing: one pass over each page's HTML gives every raw array that later expressions use."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.functions.urls import resolve_py
from evidentia.ship import ship

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote br div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
CLOSE_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEAD_ONLY = frozenset("base link meta title".split())
UNSEEN = frozenset("script style noscript template svg canvas".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html div section article".split())
_SPACE = re.compile(r"[\s ﻿]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.kids))
        return "".join(out)


class _Builder(HTMLParser):
    """A tolerant tree: void elements, implied ends of p, li, dt, dd and table cells; unknown ends are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSE_P:
            self._close(("p",), _SCOPE | {"td", "th", "li"} if tag == "p" else {"td", "th", "button"})
        if tag in _SAME:
            self._close(_SAME[tag], _SCOPE)
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = Node(tag, given, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def _close(self, tags: tuple[str, ...], stop: Any) -> None:
        n: Node | None = self.at
        found = None
        while n is not None and n.tag not in stop:
            if n.tag in tags:
                found = n
            n = n.parent
        if found is not None and found.parent is not None:
            self.at = found.parent


def parse_tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def visible_text(root: Node) -> str:
    body = next((n for n in root.walk() if n.tag == "body"), None)
    start = body or root
    out: list[str] = []
    todo: list[Node | str] = [start]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        a = n.attrs
        if n is not start and (n.tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or (body is None and n.tag in (HEAD_ONLY | {"head"}))):
            continue
        if n.tag in BLOCKS:
            todo.append(" ")
        todo.extend(reversed(n.kids))
    return squeeze("".join(out))


def _types(value: Any) -> list[str]:
    """All ``@type`` strings of parsed JSON-LD, first place kept."""
    out: dict[str, None] = {}
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            t = v.get("@type")
            for x in t if isinstance(t, list) else [t]:
                if isinstance(x, str) and x.strip():
                    out.setdefault(x.strip())
            todo.extend(reversed(list(v.values())))
    return list(out)


def _ld_answers(value: Any) -> list[dict[str, str]]:
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            t = v.get("@type")
            if "Question" in (t if isinstance(t, list) else [t]):
                q = next((v[k] for k in ("name", "text") if isinstance(v.get(k), str)), None)
                answers = v.get("acceptedAnswer")
                for a in answers if isinstance(answers, list) else [answers]:
                    text = next((a[k] for k in ("text", "name") if isinstance(a.get(k), str)), None) if isinstance(a, dict) else None
                    if q and text and squeeze(q) and squeeze(text):
                        out.append({"question": squeeze(q), "answer": squeeze(text), "source": "json-ld"})
            todo.extend(reversed(list(v.values())))
    return out


# JSON-LD types and keys that carry coverage signals, by kind.
LD_IDENTITY = frozenset("organization corporation localbusiness medicalbusiness dentist physician person".split())
LD_SERVICE = frozenset("service product offer medicalprocedure".split())
LD_ENTITY_KEYS = frozenset(("name", "legalName", "alternateName"))
LD_SERVICE_KEYS = frozenset(("serviceType", "itemOffered"))
LD_LOCATION_KEYS = frozenset(("streetAddress", "addressLocality", "addressRegion", "addressCountry", "postalCode", "areaServed"))
LD_TRUST_KEYS = frozenset(("author", "provider", "founder", "jobTitle", "credentials", "hasCredential"))
LD_CONTACT_KEYS = frozenset(("telephone", "email", "contactType"))


def ld_signals(value: Any, field: str, inherited: tuple[str, ...] = ()) -> list[dict[str, str]]:
    """Coverage signals of one JSON-LD block; a node without types has those of its parent."""
    out: list[dict[str, str]] = []
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += ld_signals(v, f"{field}[{i}]", inherited)
        return out
    if not isinstance(value, dict):
        return out
    t = value.get("@type")
    own = tuple(x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str))
    types = {x.strip().lower() for x in own or inherited}
    add = lambda kind, term, at: out.append({"kind": kind, "term": term, "field": at})
    for x in own:
        if x.strip().lower() in LD_IDENTITY:
            add("trust", x, f"{field}.@type")
        if x.strip().lower() in LD_SERVICE:
            add("service", x, f"{field}.@type")
    for k, v in value.items():
        strings = [s for s in (v if isinstance(v, list) else [v]) if isinstance(s, str)]
        strings += [s["name"] for s in (v if isinstance(v, list) else [v]) if isinstance(s, dict) and isinstance(s.get("name"), str) and k in LD_SERVICE_KEYS | LD_TRUST_KEYS | {"areaServed"}]
        kind = None
        if k in LD_ENTITY_KEYS and types & LD_IDENTITY:
            kind = "entity"
        elif k in LD_SERVICE_KEYS or (k == "name" and types & LD_SERVICE):
            kind = "service"
        elif k in LD_LOCATION_KEYS:
            kind = "location"
        elif k in LD_TRUST_KEYS:
            kind = "trust"
        elif k in LD_CONTACT_KEYS:
            kind = "contact"
        for s in strings if kind else []:
            add(kind, s, f"{field}.{k}")
        if isinstance(v, (dict, list)):
            out += ld_signals(v, f"{field}.{k}", own or inherited)
    return out


_QUESTION_FIRST = re.compile(r"^(?:what|when|where|which|who|whom|whose|why|how|is|are|was|were|can|could|do|does|did|will|would|should|may|might|have|has|had)\b", re.IGNORECASE)


def as_question(text: str) -> str | None:
    q = re.sub(r"\s+\?", "?", re.sub(r"<[^>]*>", "", squeeze(text)))
    n = len(re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", q))
    return q if q.endswith("?") and len(q) <= 220 and 2 <= n <= 30 and _QUESTION_FIRST.match(q) else None


def _html_answers(root: Node) -> list[dict[str, str]]:
    """For each heading that asks: the first paragraph with text before the next heading, among its siblings."""
    out = []
    for n in root.walk():
        if n.tag not in HEADINGS or n.parent is None or not (q := as_question(n.text())):
            continue
        kids = n.parent.kids
        for k in kids[kids.index(n) + 1 :]:
            if not isinstance(k, Node):
                continue
            if k.tag in HEADINGS:
                break
            p = k if k.tag == "p" else next((x for x in k.walk() if x.tag == "p"), None)
            if p is not None and squeeze(p.text()):
                out.append({"question": q, "answer": squeeze(p.text()), "source": "html"})
                break
    return out


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_list = lambda **f: pa.list_(pa.struct(list(f.items())))
FIELDS = pa.schema(
    [
        ("title", _S), ("metas", _list(name=_S, content=_S)), ("open_graph", pa.map_(_S, _S)), ("twitter", pa.map_(_S, _S)), ("canonical_count", _I), ("canonical_href", _S),
        ("canonical_url", _S), ("document_language", _S), ("viewport_present", _B), ("viewport", _S), ("headings", _list(level=_I, text=_S, selector=_S)), ("visible_text", _S),
        ("json_ld", _list(raw=_S, valid=_B, selector=_S, error=_S)), ("schema_types", pa.list_(_S)), ("ld_signals", _list(kind=_S, term=_S, field=_S)),
        ("links", _list(href=_S, url=_S, host=_S, internal=_B, text=_S)), ("hrefs", _list(href=_S, text=_S)), ("images", _list(src=_S, url=_S, alt=_S, selector=_S)), ("breadcrumbs", pa.list_(_S)), ("answers", _list(question=_S, answer=_S, source=_S)),
    ]
)
DDL = (
    "title string, metas array<struct<name:string,content:string>>, open_graph map<string,string>, twitter map<string,string>, canonical_count int, canonical_href string, "
    "canonical_url string, document_language string, viewport_present boolean, viewport string, headings array<struct<level:int,text:string,selector:string>>, visible_text string, "
    "json_ld array<struct<raw:string,valid:boolean,selector:string,error:string>>, schema_types array<string>, ld_signals array<struct<kind:string,term:string,field:string>>, "
    "links array<struct<href:string,url:string,host:string,internal:boolean,text:string>>, hrefs array<struct<href:string,text:string>>, images array<struct<src:string,url:string,alt:string,selector:string>>, "
    "breadcrumbs array<string>, answers array<struct<question:string,answer:string,source:string>>"
)


def _places(nodes: list[Node]) -> dict[int, int]:
    """The place of each heading among its siblings of one tag, from 1: each parent's children are counted once."""
    out: dict[int, int] = {}
    for n in nodes:
        seen: dict[str, int] = {}
        for k in n.kids:
            if isinstance(k, Node) and k.tag in HEADINGS:
                out[id(k)] = seen[k.tag] = seen.get(k.tag, 0) + 1
    return out


def parse_page(html: str | None, url: str | None) -> dict[str, Any]:
    """Everything that needs the tree of one page; a null page or URL is empty."""
    root, url = parse_tree(html or ""), url or ""
    nodes = list(root.walk())
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    metas = [n for n in nodes if n.tag == "meta"]
    named = [{"name": n.attrs["name"].strip().lower(), "content": squeeze(n.attrs.get("content"))} for n in metas if "name" in n.attrs]
    og: dict[str, str] = {}
    tw: dict[str, str] = {}
    for n in metas:
        key, content = (n.attrs.get("property") or n.attrs.get("name") or "").strip().lower(), squeeze(n.attrs.get("content"))
        for prefix, to in (("og:", og), ("twitter:", tw)):
            if key.startswith(prefix) and content:
                to.setdefault(key, content)
    canon = [n.attrs.get("href", "").strip() for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()]
    blocks, values = [], []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/ld+json":
            raw = n.text().strip()
            block = {"raw": raw, "valid": True, "selector": f'script[type="application/ld+json"]:nth-of-type({len(blocks) + 1})'}
            try:
                values.append(json.loads(raw))
            except json.JSONDecodeError as e:
                block |= {"valid": False, "error": f"{e.msg} at line {e.lineno}, column {e.colno}" if raw else "the block is empty"}
            except RecursionError:
                block |= {"valid": False, "error": "the block is nested too deeply"}
            blocks.append(block)
    own = (urlsplit(url).hostname or "").lower()
    anchors = [n for n in nodes if n.tag == "a" and "href" in n.attrs]
    links = []
    for n in anchors:
        href = n.attrs["href"].strip()
        to = resolve_py(url, href) if href and not href.startswith("#") else None
        if to:
            h = (urlsplit(to).hostname or "").lower()
            links.append({"href": href, "url": to, "host": h, "internal": h == own, "text": squeeze(n.text())})
    crumbs = []
    for n in nodes:
        a = n.attrs
        label = (n.tag == "nav" or a.get("role") == "navigation") and "breadcrumb" in a.get("aria-label", "").lower()
        if label or {"breadcrumb", "breadcrumbs"} & set(a.get("class", "").lower().split()):
            if t := squeeze(n.text()):
                crumbs.append(t)
    types = list(dict.fromkeys(t for v in values for t in _types(v)))
    title = first("title")
    places = _places(nodes)
    views = [n.attrs.get("content", "").strip() for n in metas if n.attrs.get("name", "").strip().lower() == "viewport"]
    lang = next((n.attrs["lang"].strip() for n in nodes if n.tag == "html" and "lang" in n.attrs), "")
    return {
        "title": (squeeze(title.text()) or None) if title else None, "metas": [m for m in named if m["content"]], "open_graph": og, "twitter": tw,
        "canonical_count": len(canon), "canonical_href": canon[0] if canon else None, "canonical_url": resolve_py(url, canon[0]) if canon and canon[0] else None,
        "document_language": lang or None, "viewport_present": bool(views), "viewport": next((v for v in views if v), None),
        "headings": [{"level": int(n.tag[1]), "text": squeeze(n.text()), "selector": f"{n.tag}:nth-of-type({places[id(n)]})"} for n in nodes if n.tag in HEADINGS], "visible_text": visible_text(root),
        "json_ld": blocks, "schema_types": types, "ld_signals": [s for i, v in enumerate(values) for s in ld_signals(v, f"jsonLdBlocks[{i}]")],
        "links": links, "hrefs": [{"href": n.attrs["href"].strip(), "text": squeeze(n.text())} for n in anchors],
        "images": [{"src": n.attrs.get("src", "").strip(), "url": resolve_py(url, n.attrs["src"]) if n.attrs.get("src", "").strip() else None, "alt": n.attrs.get("alt"), "selector": f"img:nth-of-type({i})"} for i, n in enumerate((n for n in nodes if n.tag == "img"), 1)],
        "breadcrumbs": crumbs, "answers": _html_answers(root) + [a for v in values for a in _ld_answers(v)],
    }


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, ``url`` and the fields of ``parse_page`` for each row, parsed once in Arrow batches."""
    ship(pages.sparkSession)
    names = [*keep, "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse_page(h, u) for h, u in zip(b.column(b.num_columns - 1).to_pylist(), b.column("url").to_pylist(), strict=True)]
            for p in parsed:
                p["open_graph"], p["twitter"] = list(p["open_graph"].items()), list(p["twitter"].items())
            made = pa.Table.from_pylist(parsed, FIELDS).combine_chunks()
            for out in made.to_batches():
                yield pa.record_batch([*(b.column(n) for n in names), *out.columns], names=[*names, *FIELDS.names])

    given = pages.select(*keep, pages[url].alias("url"), pages[html].alias("__html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{ddl}, {DDL}")
