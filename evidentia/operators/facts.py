"""Aggregate facts from CSV exports: mapping, strict normalization with row rejections, lineage, dedupe, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U

# Connectors with required and optional fields, and headers that name a field.
CONNECTORS = {
    "search-console-csv": ("search-performance", "query page date clicks impressions ctr averagePosition".split(), "dateTo device country".split()),
    "web-analytics-csv": ("web-analytics", "page date sessions".split(), "dateTo users engagementRate conversions device country".split()),
    "campaign-csv": ("campaign-performance", "campaign date spend clicks conversions".split(), ["dateTo"]),
    "lead-summary-csv": ("lead-summary", "source date leads qualifiedLeads".split(), ["dateTo"]),
}
ALIASES = {
    "query": ("query", "search query", "keyword", "top queries"), "page": ("page", "landing page", "url"), "date": ("date", "day", "start date"), "dateTo": ("date to", "end date", "dateto"),
    "clicks": ("clicks",), "impressions": ("impressions",), "ctr": ("ctr", "click through rate"), "averagePosition": ("average position", "position", "avg position"),
    "device": ("device",), "country": ("country",), "sessions": ("sessions",), "users": ("users", "active users", "total users"), "engagementRate": ("engagement rate",),
    "conversions": ("conversions", "key events"), "campaign": ("campaign", "campaign name"), "spend": ("spend", "cost", "amount spent"), "source": ("source", "channel", "lead source"),
    "leads": ("leads",), "qualifiedLeads": ("qualified leads", "mqls"),
}
#: Headers with any of these abort a file (so a "campaign name" header does too).
SENSITIVE = (
    r"\b(full )?name\b", r"\be ?mail\b", r"\b(phone|mobile|telephone)\b", r"\b(address|postal|zip code)\b", r"\b(patient|diagnos\w*|medical|health|medication)\b",
    r"\b(form (content|response|submission)|message body|free text)\b", r"\b(call (recording|transcript)|audio)\b", r"\b(credential|password|secret|access token|refresh token|oauth)\b", r"\b(ip address|(client|user|contact) id)\b",
)
INTEGERS = ("clicks", "impressions", "sessions", "users", "leads", "qualifiedLeads")
REALS = ("averagePosition", "spend", "conversions")
RATIOS = ("ctr", "engagementRate")


class ImportError_(ValueError):
    """The whole file or its mapping is unusable."""


def normalize_header(h: str) -> str:
    import re

    return re.sub(r"\s+", " ", re.sub(r"[_\-]+", " ", h.replace("﻿", ""))).strip().lower()


def check_headers(headers: list[str]) -> None:
    import re

    plain = [normalize_header(h) for h in headers]
    if not plain or any(not h for h in plain) or len(set(plain)) < len(plain):
        raise ImportError_("headers must be present and distinct")
    for h in plain:
        if any(re.search(p, h) for p in SENSITIVE):
            raise ImportError_(f"column {h!r} may hold personal data")


def suggest_mapping(headers: list[str], connector: str) -> dict[str, str]:
    """Field -> header, by the first alias that a header matches."""
    _, required, optional = CONNECTORS[connector]
    by = {normalize_header(h): h for h in headers}
    return {f: next(by[a] for a in ALIASES[f] if a in by) for f in [*required, *optional] if any(a in by for a in ALIASES[f])}


def check_mapping(mapping: dict[str, str], headers: list[str], connector: str) -> None:
    if connector not in CONNECTORS:
        raise ImportError_("unknown connector")
    _, required, optional = CONNECTORS[connector]
    if set(required) - set(mapping) or set(mapping) - {*required, *optional} or set(mapping.values()) - set(headers) or len(set(mapping.values())) < len(mapping):
        raise ImportError_("mapping doesn't fit the connector or the headers")


def is_formula(x: Column) -> Column:
    """What a spreadsheet would run: after leading white space an =, + or @, or a minus that isn't followed by a plain number or percentage."""
    # One anchored pattern: most cells fail at their first character.
    return F.coalesce(x, F.lit("")).rlike(f"^[{T.SPACES}]*(?:[=+@]|-(?![0-9]+(?:[.,][0-9]+)?%?\\z))")


def number(x: Column) -> Column:
    """Non-negative plain decimals, commas ignored; null otherwise."""
    t = F.replace(F.btrim(x), F.lit(","), F.lit(""))
    return F.when(t.rlike("^[0-9]+(\\.[0-9]+)?$"), t.try_cast("double"))


def integer(x: Column) -> Column:
    n = number(x)
    return F.when(n == F.floor(n), F.floor(n)).cast("long")


def ratio(x: Column) -> Column:
    """Percents and bare values over 1 are divided by 100; null above 1."""
    t = F.btrim(x)
    n = number(F.regexp_replace(t, "\\s*%$", ""))
    v = F.when(t.endswith("%") | (n > 1), n / 100).otherwise(n)
    return F.when(v <= 1, v)


def safe_text(x: Column, most: int = 500) -> Column:
    t = F.btrim(x)
    return F.when((t != "") & (F.length(t) <= most) & ~t.rlike("[\\r\\n\\x00]"), t)


def iso_date(x: Column) -> Column:
    t = F.btrim(x)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))


def source_id(project: Column, connector: Column, label: Column) -> Column:
    return F.concat(F.lit("source:"), F.substring(T.sha(project, connector, F.btrim(label)), 1, 32))


def normalize(rows: DataFrame, connector: str, mapping: dict[str, str], project_id: str, label: str, import_id: str, row: str = "row_number") -> DataFrame:
    """Every row with its typed fields, ``error_code`` and ``error_field`` (null where accepted) and lineage.

    Checks run in order and the first error of a row wins: formulas in mapped cells, dates, then fields of
    the kind. Values of rejected rows are never kept. ``rows`` has string columns and the number of each row.
    """
    kind, required, optional = CONNECTORS[connector]
    raw = lambda f: F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")
    blank = lambda f: F.coalesce(F.btrim(raw(f)), F.lit("")) == ""
    typed: dict[str, Column] = {"date": iso_date(raw("date")), "date_to": iso_date(raw("dateTo"))}
    snake = lambda f: {"averagePosition": "average_position", "dateTo": "date_to", "engagementRate": "engagement_rate", "qualifiedLeads": "qualified_leads"}.get(f, f)
    for f in [*required, *optional]:
        if f in ("date", "dateTo"):
            continue
        if f in INTEGERS:
            typed[f] = integer(raw(f))
        elif f in REALS:
            typed[f] = number(raw(f))
        elif f in RATIOS:
            typed[f] = ratio(raw(f))
        elif f == "page":
            page = safe_text(raw(f), 2048)
            typed[f] = F.when(page.startswith("/") | page.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), page)
            typed[f] = F.when(typed[f].rlike("(?i)^https?://"), U.canonical(typed[f])).otherwise(F.when(page.startswith("/"), page))
        else:
            typed[f] = safe_text(raw(f))
    # Typed values are computed once; checks, hashes and the result refer to them.
    names = {f: f"__{i}" for i, f in enumerate(typed)}
    rows = rows.withColumn("__formula", F.array(*[is_formula(raw(f)) for f in mapping])).withColumns({names[f]: c for f, c in typed.items()})
    typed = {f: F.col(n) for f, n in names.items()}
    formula = {f: F.col("__formula")[i] for i, f in enumerate(mapping)}
    errors: list[tuple[Column, str, str]] = [(formula[f], "FORMULA_VALUE", f) for f in [*required, *optional] if f in mapping]
    errors += [(blank("date"), "MISSING_VALUE", "date"), (typed["date"].isNull(), "INVALID_VALUE", "date")]
    errors += [(~blank("dateTo") & (typed["date_to"].isNull() | (typed["date_to"] < typed["date"])), "INVALID_VALUE", "dateTo")]
    for f in [*required, *optional]:
        if f in ("date", "dateTo"):
            continue
        if f in required:
            errors += [(blank(f), "MISSING_VALUE", f), (typed[f].isNull(), "INVALID_VALUE", f)]
        else:
            errors.append((~blank(f) & typed[f].isNull(), "INVALID_VALUE", f))
    if connector == "search-console-csv":
        observed = F.when(typed["impressions"] > 0, typed["clicks"] / typed["impressions"]).otherwise(0.0)
        errors += [(typed["clicks"] > typed["impressions"], "INVALID_VALUE", "clicks"), (F.abs(observed - typed["ctr"]) > 0.005, "INVALID_VALUE", "ctr"), (typed["averagePosition"] <= 0, "INVALID_VALUE", "averagePosition")]
        typed["device"], typed["country"] = F.coalesce(typed["device"], F.lit("all")), F.coalesce(typed["country"], F.lit("all"))
    if connector == "lead-summary-csv":
        errors.append((typed["qualifiedLeads"] > typed["leads"], "INVALID_VALUE", "qualifiedLeads"))
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(f).alias("field"))) for bad, c, f in errors])
    values = {snake(f): v for f, v in typed.items()}
    hashed = T.sha(F.lit(kind), *[T.stable_number(values[f]) if f in {snake(x) for x in (*REALS, *RATIOS)} else values[f] for f in sorted(values)])
    source = source_id(F.lit(project_id), F.lit(connector), F.lit(label))
    record = T.sha(source, hashed)
    return rows.select(
        F.col(row).cast("long").alias("row_number"), F.lit(kind).alias("metric_type"), F.lit(project_id).alias("project_id"), F.lit(import_id).alias("import_id"), source.alias("source_id"),
        *[v.alias(k) for k, v in values.items()], hashed.alias("record_hash"), record.alias("source_record_id"),
        F.concat(F.lit("metric:"), F.substring(T.sha(F.lit(project_id), record), 1, 32)).alias("metric_id"), first["code"].alias("error_code"), first["field"].alias("error_field"),
    )


def judge(normalized: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every row with its final ``error_code``: a hash seen earlier in the file, or stored for the source, is a DUPLICATE_RECORD.

    Rows with an error are their own group, so they gather nowhere.
    """
    good = F.col("error_code").isNull()
    w = Window.partitionBy("source_id", F.when(good, F.col("record_hash")).otherwise(F.col("row_number").cast("string"))).orderBy("row_number")
    marked = normalized.withColumn("_again", good & (F.row_number().over(w) > 1))
    if stored is not None:
        known = stored.select("source_id", "record_hash").distinct().withColumn("_known", F.lit(True))
        marked = marked.join(known, ["source_id", "record_hash"], "left").withColumn("_again", F.col("_again") | (good & F.coalesce("_known", F.lit(False)))).drop("_known")
    return marked.withColumn("error_code", F.when(F.col("_again"), F.lit("DUPLICATE_RECORD")).otherwise(F.col("error_code"))).drop("_again")


def split_duplicates(normalized: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of ``judge``; values of rejected rows are not kept."""
    judged = judge(normalized, stored)
    return judged.where("error_code is null").drop("error_code", "error_field"), judged.where("error_code is not null").select("row_number", "error_code", "error_field")


def counters(judged: DataFrame) -> DataFrame:
    """One row: accepted, rejected, duplicates, first and last date, from one pass over judged rows."""
    good = F.col("error_code").isNull()
    return judged.agg(
        F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.count_if(F.col("error_code") == "DUPLICATE_RECORD").alias("duplicates"),
        F.min(F.when(good, F.col("date"))).alias("date_from"), F.max(F.when(good, F.coalesce("date_to", "date"))).alias("date_to"),
    )


def filter_metrics(metrics: DataFrame, metric_type: str | None = None, page: str | None = None, query: str | None = None, device: str | None = None, country: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Metrics by type, page and query substrings, device and country, and overlap of dates; newest first.

    A filter on a field drops rows without it.
    """
    out = metrics
    if metric_type:
        out = out.where(F.col("metric_type") == metric_type)
    for name, part in (("page", page), ("query", query)):
        if part:
            out = out.where(F.contains(F.lower(name), F.lower(F.lit(part))))
    for name, value in (("device", device), ("country", country)):
        if value:
            out = out.where(F.lower(name) == value.lower())
    if date_from:
        out = out.where(F.coalesce("date_to", "date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(F.col("date") <= F.lit(date_to).cast("date"))
    return out.orderBy(F.desc("date"), "metric_id")
