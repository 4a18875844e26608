"""Structural checks of nested rows: a table of constraints compiled into one projection that lists each violation with its path."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOUND = "array<struct<path:string,problem:string>>"


class Check(NamedTuple):
    """What holds of a value: ``low`` and ``high`` bound a number, the length of a trimmed text or the size of a list; ``items`` holds for
    each element, ``fields`` for parts of a struct; ``unique`` gives what must differ between elements; ``also`` are further problems of a value."""

    required: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] | None = None
    pattern: str | None = None
    items: Check | None = None
    fields: dict[str, Check] | None = None
    unique: Callable[[Column], Column] | None = None
    also: tuple[tuple[str, Callable[[Column], Column]], ...] = ()


def _compile(value: Column, kind: T.DataType, path: Column, check: Check) -> Column:
    """The problems of a value, a nested list for each part of it."""
    one = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(text).alias("problem")))).otherwise(F.array().cast(_FOUND))
    there, out = value.isNotNull(), []
    if check.required:
        out.append(one(value.isNull(), "is missing"))
    if check.low is not None or check.high is not None:
        size = F.length(F.btrim(value)) if isinstance(kind, T.StringType) else F.size(value) if isinstance(kind, T.ArrayType | T.MapType) else value
        if check.low is not None:
            out.append(one(there & (size < check.low), f"is below {check.low:g}"))
        if check.high is not None:
            out.append(one(there & (size > check.high), f"is above {check.high:g}"))
    if check.values is not None:
        out.append(one(there & ~value.isin(*check.values), "is not a known value"))
    if check.pattern is not None:
        out.append(one(there & ~value.rlike(check.pattern), "has another form"))
    for text, bad in check.also:
        out.append(one(there & bad(value), text))
    if check.unique is not None:
        keys = F.filter(F.transform(value, check.unique), lambda k: k.isNotNull())
        out.append(one(there & (F.size(F.array_distinct(keys)) < F.size(keys)), "repeats a value"))
    if check.fields:
        parts = [_compile(value[n], kind[n].dataType, F.concat(path, F.lit(f".{n}")), c) for n, c in check.fields.items()]
        out.append(F.when(there, F.concat(*parts)).otherwise(F.array().cast(_FOUND)))
    if check.items is not None:
        each = F.transform(value, lambda x, i: _compile(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), check.items))
        out.append(F.coalesce(F.flatten(each), F.array().cast(_FOUND)))
    return F.concat(*out) if out else F.array().cast(_FOUND)


def violations(rows: DataFrame, checks: dict[str, Check], key: str) -> DataFrame:
    """``key, path, problem``: one row for each violation, from one scan without a shuffle. Columns without a check aren't read; a
    column that is checked and isn't there is missing in every row."""
    have, made = set(rows.columns), []
    for name, check in checks.items():
        if name in have:
            made.append(_compile(F.col(name), rows.schema[name].dataType, F.lit(name), check))
        elif check.required:
            made.append(F.array(F.struct(F.lit(name).alias("path"), F.lit("is missing").alias("problem"))))
    return rows.select(key, F.inline(F.concat(*made)))


def unknown(rows: DataFrame, checks: dict[str, Check], key: str) -> list[str]:
    """Columns of a request that no check names: a strict request has none."""
    return sorted(set(rows.columns) - set(checks) - {key})


_HTTP = "(?i)^\\s*https?://[^/?#\\s]+"
URL = Check(low=1, high=2048, pattern=_HTTP)
_OPTIONAL = lambda **xs: Check(required=False, **xs)
_DATE = "^\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])$"
_FLAT = lambda u: F.lower(F.regexp_replace(F.btrim(u), "(?<=[^/:])/?(#.*)?$", ""))

#: Requests of the service: fields with their bounds.
REQUESTS: dict[str, dict[str, Check]] = {
    "analyze": {"url": URL},
    "compare": {
        "target_url": URL, "competitor_urls": Check(low=1, high=5, items=URL, unique=_FLAT), "query_label": _OPTIONAL(high=200),
        "rank_observations": _OPTIONAL(items=Check(fields={"url": URL, "position": Check(low=1, high=1000)}), unique=lambda x: _FLAT(x["url"])),
    },
    "crawl": {"target_url": URL, "max_pages": _OPTIONAL(low=1, high=50), "max_depth": _OPTIONAL(low=0, high=5), "minimum_delay_ms": _OPTIONAL(low=0, high=60_000)},
    "visibility": {
        "target_url": URL, "query": Check(low=1, high=500), "engine": Check(low=1, high=100), "location": Check(low=1, high=200), "device": Check(values=("desktop", "mobile", "tablet", "other")), "observation_date": Check(pattern=_DATE),
        "observed_rank": _OPTIONAL(low=1, high=10_000), "observed_citation": _OPTIONAL(), "citation_url": _OPTIONAL(pattern=_HTTP), "notes": _OPTIONAL(high=2000), "screenshot_reference": _OPTIONAL(high=2048), "reference_url": _OPTIONAL(pattern=_HTTP),
    },
    "report": {"format": Check(values=("json", "markdown", "csv"))},
}

#: Stored runs: each part of the nested row.
RUN: dict[str, Check] = {
    "run_id": Check(), "target_url": URL, "created_at": Check(), "competitor_urls": Check(low=1, high=5, items=URL, unique=_FLAT), "query_label": _OPTIONAL(high=200),
    "sites": Check(low=2, high=6, unique=lambda s: s["input_order"], items=Check(fields={
        "role": Check(values=("target", "competitor")), "input_order": Check(low=0, high=5), "normalized_url": URL, "final_url": URL, "status": Check(values=("eligible", "degraded", "ineligible")), "usable": Check(),
        "reasons": Check(items=Check(low=1)),
    }, also=(
        ("contradicts its order", lambda s: (s["role"] == "target") != (s["input_order"] == 0)),
        ("contradicts its status", lambda s: F.when(s["status"] == "ineligible", s["usable"] | (F.size(s["reasons"]) == 0)).when(s["status"] == "degraded", ~s["usable"] | (F.size(s["reasons"]) == 0)).otherwise(~s["usable"] | (F.size(s["reasons"]) > 0))),
    ))),
    "conclusions": Check(items=Check(fields={
        "kind": Check(values=("gap", "advantage", "shared")), "rule_id": Check(pattern="^(GAP|ADV|SHARED_GAP)_[A-Z0-9_]+$"), "priority": Check(values=("high", "medium", "low")), "effort": Check(values=("high", "medium", "low")),
    }), unique=lambda c: c["rule_id"]),
}


def compare_requests(rows: DataFrame, key: str) -> DataFrame:
    """Violations of comparison requests, those between fields too: the target is no competitor, and ranks are of submitted URLs."""
    own = violations(rows, REQUESTS["compare"], key)
    flat = F.transform("competitor_urls", _FLAT)
    target = _FLAT(F.col("target_url"))
    made = F.when(F.array_contains(flat, target), F.array(F.struct(F.lit("competitor_urls").alias("path"), F.lit("holds the target").alias("problem")))).otherwise(F.array().cast(_FOUND))
    if "rank_observations" in rows.columns:
        placed = F.transform("rank_observations", lambda x, i: F.struct(F.concat(F.lit("rank_observations["), i.cast("string"), F.lit("]")).alias("path"), F.when(~F.array_contains(F.concat(F.array(target), flat), _FLAT(x["url"])), "is of no submitted URL").alias("problem")))
        made = F.concat(made, F.coalesce(F.filter(placed, lambda p: p["problem"].isNotNull()), F.array().cast(_FOUND)))
    return own.unionByName(rows.select(key, F.inline(F.coalesce(made, F.array().cast(_FOUND)))))
