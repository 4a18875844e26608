"""From parsed pages to page analyses: everything derivable from the parser's arrays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

IDENTITY_TYPES = ("organization", "corporation", "localbusiness", "medicalbusiness", "dentist", "physician", "person")
_FAQ = T.boundary("faq|frequently asked|questions? (?:and|or|&) answers?|common questions")


def meta(name: str) -> Column:
    """Contents of the named meta elements, in order."""
    return F.transform(F.filter("metas", lambda m: m["name"] == name), lambda m: m["content"])


def _strip_fragment(x: Column) -> Column:
    return F.regexp_replace(x, "#.*$", "")


def level_jumps(h: Column) -> Column:
    """Neighbours in ``h`` whose level grows by more than one."""
    pairs = F.transform(h, lambda x, i: F.struct((i - 1).alias("from_index"), i.alias("to_index"), F.get(h, i - 1)["level"].alias("from_level"), x["level"].alias("to_level"), F.get(h, i - 1)["text"].alias("from_text"), x["text"].alias("to_text")))
    return F.filter(pairs, lambda p: p["to_level"] > p["from_level"] + 1)


def repeated(h: Column) -> Column:
    """Heading texts found more than once regardless of case: first spelling, count and levels, in first-seen order."""
    full = F.filter(h, lambda x: x["text"] != "")
    heads = T.distinct_folded(F.transform(full, lambda x: x["text"]))
    same = lambda t: F.filter(full, lambda x: F.lower(x["text"]) == F.lower(t))
    return F.filter(F.transform(heads, lambda t: F.struct(t.alias("text"), F.size(same(t)).alias("count"), F.transform(same(t), lambda x: x["level"]).alias("levels"))), lambda r: r["count"] > 1)


def analyze(parsed: DataFrame) -> DataFrame:
    """One wide row for each parsed page; retrieval columns default to a direct 200 where they are missing."""
    have = set(parsed.columns)
    for name, default in (("status_code", F.lit(200)), ("redirect_count", F.lit(0)), ("requested_url", F.col("url")), ("robots_txt_available", F.lit(True)), ("sitemap_xml_available", F.lit(True)),
                          ("robots_txt_status_code", F.lit(None).cast("int")), ("sitemap_xml_status_code", F.lit(None).cast("int"))):
        if name not in have:
            parsed = parsed.withColumn(name, default)
    directives = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(F.concat(meta("robots"), meta("googlebot")), lambda c: F.split(c, "[;,]"))), lambda d: F.lower(F.btrim(d))), lambda d: d != ""))
    has = lambda *xs: F.arrays_overlap("directives", F.array(*[F.lit(x) for x in xs]))
    canonical = (
        F.when(F.col("canonical_count") == 0, "missing").when(F.col("canonical_url").isNull(), "invalid")
        .when(F.col("canonical_url") == _strip_fragment(F.col("url")), "match").otherwise("mismatch")
    )
    kinds = lambda t: F.filter("links", lambda x: x["internal"] == t)
    urls = lambda t: F.array_sort(F.array_distinct(F.transform(kinds(t), lambda x: x["url"])))
    answers = F.transform("answers", lambda a, i: F.struct(F.lower(F.concat(a["question"], F.lit("\x1f"), a["answer"])).alias("k"), a.alias("a")))
    first = F.filter(answers, lambda a, i: F.array_position(F.transform(answers, lambda x: x["k"]), a["k"]) - 1 == i)
    texts = F.transform(F.filter("headings", lambda h: h["text"] != ""), lambda h: h["text"])
    out = (
        parsed.withColumn("title_length", F.coalesce(F.length("title"), F.lit(0)))
        .withColumn("meta_description", F.get(meta("description"), 0)).withColumn("meta_description_length", F.coalesce(F.length("meta_description"), F.lit(0)))
        .withColumn("robots_meta", F.get(meta("robots"), 0)).withColumn("directives", directives)
        .withColumn("indexability", F.when(has("noindex", "none"), "explicit-noindex").when(has("index", "all"), "explicit-index").otherwise("not-specified"))
        .withColumn("is_indexable", F.col("indexability") != "explicit-noindex").withColumn("canonical_status", canonical)
        .withColumn("h1_text", F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])).withColumn("h1_count", F.size("h1_text"))
        .withColumn("heading_count", F.size("headings")).withColumn("empty_heading_count", F.size(F.filter("headings", lambda h: h["text"] == "")))
        .withColumn("level_jumps", level_jumps(F.col("headings"))).withColumn("repeated_headings", repeated(F.col("headings")))
        .withColumn("word_count", T.word_count(F.col("visible_text"))).withColumn("sentences", T.sentences(F.col("visible_text"))).withColumn("sentence_count", F.size("sentences"))
        .withColumn("direct_answers", F.transform(first, lambda x: x["a"])).withColumn("direct_answer_count", F.size("direct_answers"))
    )
    asked = F.array_compact(F.concat(F.transform(texts, T.question), F.transform("sentences", T.question), F.transform("direct_answers", lambda a: T.question(a["question"]))))
    faq = F.filter(texts, lambda t: t.rlike(_FAQ))
    faq_type = F.exists("schema_types", lambda t: F.lower(t) == "faqpage")
    return (
        out.withColumn("detected_questions", T.distinct_folded(asked)).withColumn("question_count", F.size("detected_questions"))
        .withColumn("faq_indicators", F.concat(faq, F.when(faq_type, F.array(F.lit("FAQPage"))).otherwise(F.array().cast("array<string>"))))
        .withColumn("jsonld_error_count", F.size(F.filter("json_ld", lambda b: ~b["valid"])))
        .withColumn("internal_link_count", F.size(kinds(True))).withColumn("external_link_count", F.size(kinds(False)))
        .withColumn("internal_urls", urls(True)).withColumn("external_urls", urls(False))
        .withColumn("external_domains", F.array_sort(F.array_distinct(F.transform(kinds(False), lambda x: x["host"]))))
        .withColumn("empty_anchor_count", F.size(F.filter("links", lambda x: x["text"] == "")))
        .withColumn("image_count", F.size("images")).withColumn("images_missing_alt", F.size(F.filter("images", lambda x: x["alt"].isNull() | (F.btrim(x["alt"]) == ""))))
        .withColumn("has_identity_type", F.exists("schema_types", lambda t: F.lower(t).isin(*IDENTITY_TYPES)))
        .withColumn("is_home", F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+/*([^?#]*)", 1) == "")
    )


def link_edges(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """The link graph: one row for each http link of a page, in document order."""
    return parsed.select(key, "url", F.posexplode("links").alias("ordinal", "l")).select(
        key, F.col("url").alias("page_url"), "ordinal", F.col("l.url").alias("target_url"), F.col("l.href").alias("href"), F.when(F.col("l.internal"), "internal").otherwise("external").alias("type"), F.col("l.text").alias("anchor_text")
    )


def anchor_summary(edges: DataFrame, key: str = "page_id") -> DataFrame:
    """Anchor texts of each page regardless of case: first spelling, counts by type, targets in first-seen order."""
    full = edges.where("anchor_text <> ''").withColumn("folded", F.lower("anchor_text"))
    targets = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "target_url"))), lambda x: x["target_url"])
    return full.groupBy(key, "folded").agg(
        F.min_by("anchor_text", "ordinal").alias("anchor_text"), F.count("*").alias("n"), F.count_if(F.col("type") == "internal").alias("n_internal"),
        F.count_if(F.col("type") == "external").alias("n_external"), F.array_distinct(targets).alias("urls"),
    ).drop("folded")
