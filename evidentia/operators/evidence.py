"""Evidence: the raw records of a page, what stands behind a metric, and the bundles of a comparison's conclusions.

One wide row of a page yields all its pieces in one projection; pieces of a metric are exploded only for runs that have a
conclusion on it. Sites meet their run's conclusions by run, and bundles are one grouping by run and conclusion of at most
six sites each: where sites lie together by run (``together``), nothing but their keys moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import compare, coverage

SNIPPET = 300
# The selector of a metric or record, and metrics by the kind of signals that stand behind them.
TITLE, META, CANONICAL, ROBOTS, VIEWPORT = "title", 'meta[name="description"]', 'link[rel="canonical"]', 'meta[name="robots"]', 'meta[name="viewport"]'
HEADINGS, SCRIPT = "h1, h2, h3, h4, h5, h6", 'script[type="application/ld+json"]'
SELECTORS = {
    TITLE: ("hasTitle", "titleLength"), META: ("hasMetaDescription", "descriptionLength"), CANONICAL: ("canonicalMatches", "canonicalStatus"), "html": ("hasLanguage", "documentLanguage"), VIEWPORT: ("viewportPresent",),
    "h1": ("h1Count", "h1StructureValid"), HEADINGS: ("totalHeadingCount", "headingJumpCount", "emptyHeadingCount", "repeatedHeadingCount"), SCRIPT: ("schemaTypeCount", "jsonLdParseErrorCount", "schemaTypes"),
    "body": ("wordCount", "questionCount", "faqIndicatorCount", "directAnswerCount", "topicTermCount", "serviceTermCount", "locationTermCount", "topicTerms", "detectedQuestions"),
    "a[href]": ("internalLinkCount", "externalLinkCount", "uniqueInternalUrlCount", "uniqueExternalDomainCount", "emptyAnchorCount"), "img": ("imageCount", "imagesMissingAltCount"),
}
SIGNALS = {
    "serviceTermCount": ("service",), "locationTermCount": ("location",), "hasLocationSignals": ("location",), "hasIdentitySignals": ("entity",), "hasTrustSignals": ("trust",), "hasContactSignals": ("contact",),
    "topicTermCount": ("content-section", "service", "entity", "location"), "topicTerms": ("content-section", "service", "entity", "location"),
}
_PIECE = "struct<field:string,value:string,selector:string,snippet:string>"


def _piece(field: Column, value: Column, selector: Column | None = None, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(field.alias("field"), value.cast("string").alias("value"), (none if selector is None else selector).alias("selector"), (none if snippet is None else snippet).alias("snippet"))


def _cut(text: Column) -> Column:
    """A snippet of some text; none of an empty one."""
    return F.nullif(F.substring(text, 1, SNIPPET), F.lit(""))


def raw_records(analyses: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, ordinal, field, observed_value, selector``: the 25 records of each analysed page; values of several parts are JSON."""
    c, j = F.col, lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    have = set(analyses.columns)
    parts = lambda **xs: j(F.struct(*[v.alias(n) for n, v in xs.items()]))
    dims = [n for n in ("entity", "service", "location", "trust", "contact", "section") if f"{n}_terms" in have]
    covered = j(F.struct(*[F.struct((c(f"{n}_count") > 0).alias("present"), c(f"{n}_count").cast("long").alias("count"), c(f"{n}_terms").alias("terms")).alias(n) for n in dims if f"{n}_count" in have]))
    issues = F.filter(F.transform("images", lambda x: F.struct(x["src"].alias("src"), F.when(x["alt"].isNull(), "missing-attribute").when(F.btrim(x["alt"]) == "", "empty-value").alias("reason"))), lambda x: x["reason"].isNotNull())
    # Field, value and selector of each record.
    records = [
        ("statusCode", c("status_code"), None), ("normalizedUrl", c("requested_url"), None), ("finalUrl", c("url"), None), ("redirectCount", c("redirect_count"), None), ("title", c("title"), TITLE), ("metaDescription", c("meta_description"), META),
        ("canonicalStatus", parts(raw=c("canonical_href"), resolved=c("canonical_url"), status=c("canonical_status")), CANONICAL), ("indexability", parts(status=c("indexability"), isIndexable=c("is_indexable")), ROBOTS),
        ("documentLanguage", c("document_language"), "html"), ("viewportPresent", c("viewport_present"), VIEWPORT), ("headingHierarchy", j(c("headings")) if "headings" in have else F.lit(None), HEADINGS), ("headingLevelJumps", j(c("level_jumps")), None),
        ("repeatedHeadings", j(c("repeated_headings")), None), ("visibleText", c("visible_text"), "body"),
        ("contentCounts", parts(wordCount=c("word_count"), sentenceCount=c("sentence_count") if "sentence_count" in have else F.lit(None).cast("int"), questionCount=c("question_count"), directAnswerCount=c("direct_answer_count")), None),
        ("detectedQuestions", j(c("detected_questions")), None), ("faqIndicators", j(c("faq_indicators")), None), ("breadcrumbIndicators", j(c("breadcrumbs")), None), ("jsonLdParseErrors", j(F.filter("json_ld", lambda b: ~b["valid"])), SCRIPT),
        ("schemaTypes", j(c("schema_types")), SCRIPT), ("links", parts(internalLinkCount=c("internal_link_count"), externalLinkCount=c("external_link_count"), uniqueInternalUrls=c("internal_urls"), externalDomains=c("external_domains"), emptyAnchorCount=c("empty_anchor_count")), "a[href]"),
        ("images", parts(imageCount=c("image_count"), imagesMissingAlt=c("images_missing_alt"), issues=issues), "img"), ("coverage", covered, None), ("robotsTxt", parts(available=c("robots_txt_available"), statusCode=c("robots_txt_status_code")), None),
        ("sitemapXml", parts(available=c("sitemap_xml_available"), statusCode=c("sitemap_xml_status_code")), None),
    ]
    made = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("observed_value"), F.lit(s).cast("string").alias("selector")) for f, v, s in records])
    return analyses.select(key, F.posexplode(made).alias("ordinal", "r")).select(key, "ordinal", "r.*")


def with_signals(analyses: DataFrame, key: str = "page_id") -> DataFrame:
    """``analyses`` with ``signals``: each page's kept coverage signals in order."""
    rows = coverage.signals(analyses, key)
    item = F.struct("ordinal", "kind", "term", "field", "selector", "snippet")
    return analyses.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("signals")), key, "left")


def together(rows: DataFrame, key: str, a_task: int = 40_000) -> DataFrame:
    """``rows`` of a key in one task and in order, before wide columns are made of them: what groups or joins them by the key later shuffles and sorts no wide rows."""
    return rows.repartition(max(1, math.ceil(rows.count() / a_task)), key).sortWithinPartitions(key)


def metric_index(sites: DataFrame) -> DataFrame:
    """``run_id, input_order, usable, source_url, metric, observed_value, pieces``: each site's metrics and value lists with the
    evidence behind them, the metric itself first, then questions, answers or signals. ``signals`` is used where ``sites`` has it."""
    return sites.select("run_id", "input_order", "usable", F.col("url").alias("source_url"), F.inline(_index(sites)))


def _index(sites: DataFrame) -> Column:
    """The metrics of a site with values and pieces, one array a row."""
    have, none = set(sites.columns), F.array().cast(f"array<{_PIECE}>")
    snippets = {
        TITLE: F.nullif("title", F.lit("")), META: F.nullif("meta_description", F.lit("")), CANONICAL: F.nullif("canonical_href", F.lit("")), "h1": _cut(F.array_join("h1_text", " | ")), "body": _cut(F.col("visible_text")),
    }
    if "headings" in have:
        snippets[HEADINGS] = _cut(F.array_join(F.slice(F.filter(F.transform("headings", lambda h: h["text"]), lambda t: t != ""), 1, 6), " | "))
    selector = {m: s for s, ms in SELECTORS.items() for m in ms}
    listed = lambda xs: F.to_json(xs)
    numbers = {m: c.cast("string") for m, c in compare.metric_columns(sites.columns).items()}
    values = numbers | {"schemaTypes": listed(F.col("schema_types")), "topicTerms": listed(compare.topics()), "detectedQuestions": listed(F.col("detected_questions"))}
    asked = F.transform("detected_questions", lambda q, i: _piece(F.concat(F.lit("detectedQuestions["), i.cast("string"), F.lit("]")), q, None, q))
    told = F.transform("direct_answers", lambda a, i: _piece(F.concat(F.lit("directAnswers["), i.cast("string"), F.lit("]")), F.to_json(a))) if "direct_answers" in have else none

    def more(metric: str) -> Column:
        if metric in ("questionCount", "detectedQuestions"):
            return asked
        if metric == "directAnswerCount":
            return told
        if metric in SIGNALS and "signals" in have:
            kinds = SIGNALS[metric]
            of = lambda kind: F.transform(F.filter(F.coalesce("signals", F.array().cast(sites.schema["signals"].dataType)), lambda s: s["kind"] == kind), lambda s: _piece(s["field"], s["term"], s["selector"], s["snippet"]))
            return F.concat(*[of(k) for k in kinds])
        return none

    made = []
    for metric, value in values.items():
        at = selector.get(metric)
        first = _piece(F.lit(metric), value, F.lit(at).cast("string"), snippets.get(at))
        made.append(F.struct(F.lit(metric).alias("metric"), value.alias("observed_value"), F.concat(F.array(first), more(metric)).alias("pieces")))
    return F.array(*made)


def bundles(conclusions: DataFrame, sites: DataFrame) -> DataFrame:
    """``run_id, kind, rule_id, target_evidence, competitors``: for each conclusion the target's pieces, and one bundle a usable competitor in
    input order (``input_order, source_url, observed_value, benchmark, pieces``).

    A competitor is a benchmark where it has the value that the conclusion compares with: the best number, the flag, or one of the
    ``missing`` values. ``conclusions`` are ``compare.conclusions`` and ``compare.competitor_only`` together (``compare.every_conclusion``).
    """
    wanted = conclusions.groupBy("run_id").agg(F.collect_list(F.struct("kind", "rule_id", "metric", "benchmark", "missing")).alias("wanted"))
    asked = sites.where((F.col("input_order") == 0) | F.col("usable")).withColumn("visible_text", F.substring("visible_text", 1, SNIPPET)).join(wanted, "run_id")
    index = asked.select("run_id", "input_order", F.col("url").alias("source_url"), "wanted", F.inline(F.filter(_index(sites), lambda x: F.exists("wanted", lambda w: w["metric"] == x["metric"]))))
    rows = index.select("run_id", "input_order", "source_url", "metric", "observed_value", "pieces", F.explode(F.filter("wanted", lambda w: w["metric"] == F.col("metric"))).alias("w"))
    rows = rows.select("*", "w.kind", "w.rule_id", "w.benchmark", "w.missing").drop("w")
    flags = [m for _, _, m, _ in compare.BOOLEAN]
    text = F.col("observed_value")
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    number = F.when(F.col("metric").isin(flags), (number > 0).cast("double")).otherwise(number)
    theirs = F.transform(F.from_json(text, "array<string>"), lambda x: F.lower(F.btrim(x)))
    flagged = F.when(F.col("missing").isNotNull(), F.arrays_overlap(theirs, F.col("missing"))).otherwise(number == F.col("benchmark"))
    bundle = F.struct("input_order", "source_url", "observed_value", F.coalesce(flagged, F.lit(False)).alias("benchmark"), "pieces")
    target = F.col("input_order") == 0
    return rows.groupBy("run_id", "kind", "rule_id").agg(F.first(F.when(target, F.col("pieces")), ignorenulls=True).alias("target_evidence"), F.array_sort(F.collect_list(F.when(~target, bundle))).alias("competitors"))


def incomplete(found: DataFrame, sites: DataFrame) -> DataFrame:
    """``run_id, rule_id, problem`` of bundles that don't hold: not one for each usable competitor in order, none that is a benchmark, or no target evidence."""
    order = F.array_sort(F.collect_list(F.when((F.col("input_order") > 0) & F.col("usable"), F.col("input_order"))))
    want = sites.groupBy("run_id").agg(order.alias("wanted"))
    problem = (
        F.when(F.coalesce(F.size("target_evidence"), F.lit(0)) < 1, "no target evidence").when(F.transform("competitors", lambda b: b["input_order"]) != F.col("wanted"), "not one bundle for each usable competitor")
        .when(~F.exists("competitors", lambda b: b["benchmark"]), "no benchmark").when(F.exists("competitors", lambda b: F.size(b["pieces"]) < 1), "a bundle without evidence")
    )
    return found.join(want, "run_id", "left").withColumn("problem", problem).where("problem is not null").select("run_id", "rule_id", "problem")
