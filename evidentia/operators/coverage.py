"""Coverage signals: service, trust, contact, location, section and entity evidence of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T

# Words and phrases that signal each kind.
SERVICE = "services?|treatments?|consultations?|care|therapy|repairs?|installations?|solutions?|aligners?|dentistry|orthodontics?|pricing"
TRUST = "author|provider|doctor(?:-led)?|dentist|physician|specialist|licensed|certified|credentials?|experience|our team|about us"
CONTACT = "contact us|call us|email us|telephone|phone|address|directions|book (?:a |an )?(?:visit|appointment|consultation)"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
PHONE = "\\+?[0-9][0-9\\s().-]{7,}[0-9]"
LOCATION = "(?:^|[^A-Za-z0-9_])(?:located in|based in|serving|near|in)\\s+([\\p{Lu}][\\p{L}.'-]+(?:\\s+[\\p{Lu}][\\p{L}.'-]+){0,2})"
SECTIONS = {
    "faq": "faq|frequently asked|questions? (?:and|&) answers?",
    "services": "services?|treatments?|what we (?:do|offer)",
    "process": "how it works|process|what to expect",
    "pricing": "pricing|costs?|financing|fees?",
    "identity": "about|our team|provider|doctor|author",
    "contact": "contact|location|directions|hours",
    "trust": "credentials?|experience|reviews?|testimonials?",
    "benefits": "benefits?|why choose|advantages?",
}
PLACEHOLDER = "^(?:your|enter|insert)[ _-]+.*(?:street|address|city|state|zip|postal|name|phone|email)"
DANGLING = "(?:^|\\s)(?:you|we|our|the|a|an|and|or)$"
KINDS = ("entity", "service", "location", "trust", "contact", "content-section")


def _word(alternatives: str) -> str:
    return f"(?i)\\b({alternatives})\\b"


AROUND = 45
_SIGNAL = "array<struct<kind:string,term:string,field:string,method:string,heuristic:boolean,selector:string,snippet:string>>"


def spans(text: Column, pattern: str) -> Column:
    """``start, text`` (from 0) of each match in order, matches are fenced by a mark, and places are sums of what stands before."""
    marked = F.regexp_replace(F.translate(text, "\x01", " "), f"({pattern})", "\x01$1\x01")
    pieces = F.split(marked, "\x01")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("found"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["p"])).alias("at"), F.when(x["i"] % 2 == 1, F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), x["p"].alias("text"))))).otherwise(s["found"]).alias("found"))
    counted = lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    # Most texts have no match: they are scanned once and nothing is made of them.
    return F.when(text.rlike(pattern), F.aggregate(counted(pieces), empty, step)["found"]).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def snippet(text: Column, start: Column, length: Column) -> Column:
    """What stands up to ``AROUND`` characters around a span, its white space collapsed."""
    begin = F.greatest(F.lit(0), start - AROUND)
    return T.collapse(F.substr(text, begin + 1, start + length + AROUND - begin))


def _signal(kind: str | Column, term: Column, field: Column, method: str, heuristic: bool, selector: Column, shown: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), term.alias("term"), field.alias("field"), F.lit(method).alias("method"), F.lit(heuristic).alias("heuristic"), selector.alias("selector"), shown.alias("snippet"))


def _found(source: Column, kind: str, pattern: str, heuristic: bool, inner: str | None = None) -> Column:
    """Signals of the matches; where the term is a part of a match, ``inner`` picks it and the character before the match isn't its own."""
    text = source["text"]
    term = lambda m: T.collapse(m["text"] if inner is None else F.regexp_extract(m["text"], inner, 1))
    lead = lambda m: F.when(m["text"].rlike("^[^A-Za-z0-9_]"), 1).otherwise(0) if inner else F.lit(0)
    return F.transform(spans(text, pattern), lambda m: _signal(kind, term(m), source["field"], "text-pattern", heuristic, source["selector"], snippet(text, m["start"] + lead(m), F.length(m["text"]) - lead(m))))


def text_signals(source: Column) -> Column:
    """All signals of one (field, text, selector) struct."""
    og = F.when((source["field"] == "openGraph.og:site_name") & (source["text"] != ""), F.array(_signal("entity", source["text"], source["field"], "metadata", False, source["selector"], source["text"])))
    sections = F.array_compact(
        F.array(*[F.when((source["field"] == "headings") & source["text"].rlike(_word(p)), _signal("content-section", F.lit(k), source["field"], "heading-pattern", True, source["selector"], source["text"])) for k, p in SECTIONS.items()])
    )
    return F.concat(
        _found(source, "service", _word(SERVICE), True), _found(source, "trust", _word(TRUST), True), _found(source, "contact", _word(CONTACT), True), _found(source, "contact", f"\\b({EMAIL})\\b", False),
        _found(source, "contact", f"({PHONE})", True), _found(source, "location", LOCATION, True, LOCATION), sections, F.coalesce(og, F.array().cast(_SIGNAL)),
    )


def sources() -> Column:
    """The texts of a page that carry signals, in order."""
    s = lambda field, x, at: F.struct(F.lit(field).alias("field"), x.alias("text"), (F.lit(at) if isinstance(at, str) else at).alias("selector"))
    single = F.array(s("title", F.col("title"), "title"), s("metaDescription", F.get(F.transform(F.filter("metas", lambda m: m["name"] == "description"), lambda m: m["content"]), 0), 'meta[name="description"]'))
    heads = F.transform(F.filter("headings", lambda h: h["text"] != ""), lambda h: s("headings", h["text"], h["selector"]))
    rest = F.array(s("visibleText", F.col("visible_text"), "body"), s("openGraph.og:site_name", F.element_at("open_graph", "og:site_name"), 'meta[property="og:site_name"]'))
    return F.filter(F.concat(single, heads, rest), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def signals(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each kept signal: JSON-LD first, then texts, then mailto: and tel: links; first of a term wins."""
    block = lambda x: F.concat(F.lit('script[type="application/ld+json"]:nth-of-type('), (F.regexp_extract(x["field"], "\\[(\\d+)\\]", 1).cast("int") + 1).cast("string"), F.lit(")"))
    ld = F.transform("ld_signals", lambda x: _signal(x["kind"], T.collapse(x["term"]), x["field"], "json-ld", False, block(x), x["term"]))
    href = lambda h: F.regexp_replace(F.regexp_replace(h["href"], "^[A-Za-z]+:", ""), "\\?.*$", "")
    placed = F.transform("hrefs", lambda h, i: F.struct(h["href"].alias("href"), h["text"].alias("text"), i.alias("i")))
    protocol = F.filter(placed, lambda h: F.lower(h["href"]).rlike("^(mailto|tel):"))
    links = F.transform(protocol, lambda h: _signal("contact", href(h), F.lit("links"), "link-protocol", False, F.concat(F.lit("a[href]:nth-of-type("), (h["i"] + 1).cast("string"), F.lit(")")), F.coalesce(F.nullif(h["text"], F.lit("")), h["href"])))
    every = F.concat(ld, F.flatten(F.transform(sources(), text_signals)), links)
    # Dealt by page once: the window and every grouping by page that follows need no shuffle of their own.
    rows = pages.select(key, F.posexplode(every).alias("ordinal", "s")).select(key, "ordinal", "s.*").repartition(F.col(key)).withColumn("folded", F.lower("term"))
    spaced = F.regexp_replace("folded", "[_-]", " ")
    dangling = (F.col("kind") == "location") & F.col("folded").rlike(DANGLING)
    rows = rows.where((F.col("term") != "") & ~spaced.rlike(PLACEHOLDER) & ~dangling)
    first = Window.partitionBy(key, "kind", "folded", "field").orderBy("ordinal")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def dimensions(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """By page and kind: the number of signals, and distinct terms in first place but last spelling."""
    per_term = rows.groupBy(key, "kind", "folded").agg(F.min("ordinal").alias("at"), F.max_by("term", "ordinal").alias("term"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    return per_term.groupBy(key, "kind").agg(F.sum("n").alias("count"), ordered.alias("terms"))


def with_coverage(analyses: DataFrame, key: str = "page_id") -> DataFrame:
    """``analyses`` with ``<kind>_count`` and ``<kind>_terms`` of the six dimensions."""
    d = dimensions(signals(analyses, key), key)
    named = {k: k.replace("content-section", "section") for k in KINDS}
    wide = d.groupBy(key).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("count"))).alias(f"{n}_count") for k, n in named.items()],
        *[F.first(F.when(F.col("kind") == k, F.col("terms")), ignorenulls=True).alias(f"{n}_terms") for k, n in named.items()],
    )
    out = analyses.join(wide, key, "left")
    for n in named.values():
        out = out.withColumn(f"{n}_count", F.coalesce(f"{n}_count", F.lit(0).cast("long"))).withColumn(f"{n}_terms", F.coalesce(f"{n}_terms", F.array().cast("array<string>")))
    return out
