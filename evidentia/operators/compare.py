"""Target against competitors: metric rows, gaps, advantages, shared gaps, set gaps, proposals.

Sites carry ``run_id`` and ``input_order`` (0 is the target). All conclusions of all runs come from one
grouping of the long metric table; the rule tables are small literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule, metric, threshold, whether lower is better, priority, effort.
SCALAR = (
    ("HEADING_COVERAGE", "totalHeadingCount", 2, False, "medium", "medium"),
    ("CONTENT_BREADTH", "wordCount", 100, False, "medium", "high"),
    ("QUESTION_COVERAGE", "questionCount", 1, False, "medium", "medium"),
    ("DIRECT_ANSWERS", "directAnswerCount", 1, False, "medium", "medium"),
    ("INTERNAL_LINKS", "internalLinkCount", 3, False, "medium", "low"),
    ("IMAGE_ALT", "imagesMissingAltCount", 1, True, "medium", "low"),
    ("HEADING_JUMPS", "headingJumpCount", 1, True, "low", "low"),
    ("EMPTY_HEADINGS", "emptyHeadingCount", 1, True, "low", "low"),
    ("REPEATED_HEADINGS", "repeatedHeadingCount", 1, True, "low", "low"),
    ("EMPTY_ANCHORS", "emptyAnchorCount", 1, True, "low", "low"),
    ("JSONLD_ERRORS", "jsonLdParseErrorCount", 1, True, "high", "low"),
    ("SERVICE_CLARITY", "serviceTermCount", 1, False, "medium", "medium"),
    ("LOCATION_CLARITY", "locationTermCount", 1, False, "medium", "low"),
)
# Gap name, advantage name, metric, priority.
BOOLEAN = (
    ("INDEXABILITY", "INDEXABILITY", "indexable", "high"),
    ("TITLE_MISSING", "TITLE_PRESENT", "hasTitle", "high"),
    ("DESCRIPTION_MISSING", "DESCRIPTION_PRESENT", "hasMetaDescription", "medium"),
    ("CANONICAL_MISMATCH", "CANONICAL_MATCH", "canonicalMatches", "high"),
    ("LANGUAGE_MISSING", "LANGUAGE_PRESENT", "hasLanguage", "low"),
    ("VIEWPORT_MISSING", "VIEWPORT_PRESENT", "viewportPresent", "medium"),
    ("H1_STRUCTURE", "H1_STRUCTURE", "h1StructureValid", "medium"),
    ("FAQ_STRUCTURE", "FAQ_STRUCTURE", "faqIndicatorCount", "medium"),
    ("IDENTITY_SIGNALS", "IDENTITY_SIGNALS", "hasIdentitySignals", "high"),
    ("TRUST_SIGNALS", "TRUST_SIGNALS", "hasTrustSignals", "medium"),
    ("CONTACT_SIGNALS", "CONTACT_SIGNALS", "hasContactSignals", "medium"),
    ("LOCATION_SIGNALS", "LOCATION_SIGNALS", "hasLocationSignals", "medium"),
)
SHARED = (
    ("SHARED_GAP_DESCRIPTION_MISSING", "hasMetaDescription", "medium"),
    ("SHARED_GAP_IDENTITY_SIGNALS", "hasIdentitySignals", "high"),
    ("SHARED_GAP_TRUST_SIGNALS", "hasTrustSignals", "medium"),
    ("SHARED_GAP_CONTACT_SIGNALS", "hasContactSignals", "medium"),
)
# Metrics by artifact, artifacts that a qualified professional has to review, and category by metric (technical where none is given).
ARTIFACTS = {
    "title": ("hasTitle", "titleLength"), "meta-description": ("hasMetaDescription", "descriptionLength"), "canonical": ("canonicalMatches", "canonicalStatus"),
    "heading-structure": ("h1Count", "h1StructureValid", "totalHeadingCount", "headingJumpCount", "emptyHeadingCount", "repeatedHeadingCount"),
    "visible-faq-and-jsonld": ("questionCount", "faqIndicatorCount", "directAnswerCount", "detectedQuestions"), "structured-data": ("schemaTypes", "schemaTypeCount", "jsonLdParseErrorCount"),
    "provider-or-reviewer-block": ("hasIdentitySignals", "hasTrustSignals"), "trust-or-contact-block": ("hasContactSignals", "hasLocationSignals", "locationTermCount"),
    "internal-links": ("internalLinkCount", "uniqueInternalUrlCount", "emptyAnchorCount"), "image-alt-guidance": ("imagesMissingAltCount", "imageCount"), "page-brief": ("topicTerms", "topicTermCount", "serviceTermCount", "wordCount"),
}
PROFESSIONAL = ("provider-or-reviewer-block", "references-and-risk-section", "visible-faq-and-jsonld")
CATEGORIES = {
    "schemaTypes": "schema", "schemaTypeCount": "schema", "jsonLdParseErrorCount": "schema",
    "questionCount": "answerability", "faqIndicatorCount": "answerability", "directAnswerCount": "answerability", "detectedQuestions": "answerability",
    "hasIdentitySignals": "entity", "hasContactSignals": "entity", "hasLocationSignals": "entity", "locationTermCount": "entity", "hasTrustSignals": "trust",
    "wordCount": "content", "topicTermCount": "content", "serviceTermCount": "content", "topicTerms": "content",
    "totalHeadingCount": "retrieval-support", "internalLinkCount": "retrieval-support", "uniqueInternalUrlCount": "retrieval-support", "uniqueExternalDomainCount": "retrieval-support",
}


def topics() -> Column:
    """Distinct terms of four dimensions in the order of a dictionary (a, A, b, B)."""
    distinct = F.array_distinct(F.concat("section_terms", "service_terms", "entity_terms", "location_terms"))
    return F.transform(F.array_sort(F.transform(distinct, lambda x: F.collate(x, "UNICODE"))), lambda x: F.collate(x, "UTF8_BINARY"))


def metric_columns(columns: list[str] | None = None) -> dict[str, Column]:
    """The 43 metrics over a page analysis with coverage; text metrics are strings. Status codes of the root resources
    are null unless ``columns``, those of the analyses, have them."""
    c, size = F.col, F.size
    ok = c("status_code").between(200, 299)
    code = lambda name: c(name) if name in (columns or ["status_code"]) else F.lit(None).cast("int")
    return {
        "statusCode": code("status_code"), "redirectCount": c("redirect_count"), "indexable": ok & c("is_indexable"), "indexabilityStatus": c("indexability"),
        "robotsTxtAvailable": c("robots_txt_available"), "robotsTxtStatusCode": code("robots_txt_status_code"), "sitemapXmlAvailable": c("sitemap_xml_available"), "sitemapXmlStatusCode": code("sitemap_xml_status_code"),
        "hasTitle": c("title_length") > 0, "titleLength": c("title_length"), "hasMetaDescription": c("meta_description_length") > 0, "descriptionLength": c("meta_description_length"),
        "canonicalMatches": c("canonical_status") == "match", "canonicalStatus": c("canonical_status"), "hasLanguage": c("document_language").isNotNull(), "documentLanguage": c("document_language"),
        "viewportPresent": c("viewport_present"), "h1Count": c("h1_count"), "h1StructureValid": c("h1_count") == 1, "totalHeadingCount": c("heading_count"),
        "headingJumpCount": size("level_jumps"), "emptyHeadingCount": c("empty_heading_count"), "repeatedHeadingCount": size("repeated_headings"), "wordCount": c("word_count"),
        "questionCount": c("question_count"), "faqIndicatorCount": size("faq_indicators"), "directAnswerCount": c("direct_answer_count"), "schemaTypeCount": size("schema_types"),
        "jsonLdParseErrorCount": c("jsonld_error_count"), "internalLinkCount": c("internal_link_count"), "uniqueInternalUrlCount": size("internal_urls"), "externalLinkCount": c("external_link_count"),
        "uniqueExternalDomainCount": size("external_domains"), "imageCount": c("image_count"), "imagesMissingAltCount": c("images_missing_alt"), "emptyAnchorCount": c("empty_anchor_count"),
        "topicTermCount": size(F.array_distinct(F.concat("section_terms", "service_terms", "entity_terms", "location_terms"))), "serviceTermCount": size("service_terms"), "locationTermCount": size("location_terms"),
        "hasIdentitySignals": c("entity_count") > 0, "hasTrustSignals": c("trust_count") > 0, "hasContactSignals": c("contact_count") > 0, "hasLocationSignals": c("location_count") > 0,
    }


#: The metrics that a rule names: no other has conclusions.
RULED = frozenset([r[1] for r in SCALAR] + [r[2] for r in BOOLEAN])


def long_metrics(sites: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """``run_id, input_order, usable, metric, number, label`` of all metrics or ``only`` some: booleans are 0 and 1, text metrics are labels."""
    columns = {n: c for n, c in metric_columns(sites.columns).items() if only is None or n in only}
    kinds = dict(zip(columns, (f.dataType.typeName() for f in sites.select(*columns.values()).schema), strict=True))
    made = [F.struct(F.lit(n).alias("metric"), (F.lit(None) if kinds[n] == "string" else c.cast("int" if kinds[n] == "boolean" else "double")).cast("double").alias("number"), (c if kinds[n] == "string" else F.lit(None)).cast("string").alias("label")) for n, c in columns.items()]
    return sites.select("run_id", "input_order", "usable", F.inline(F.array(*made)))


def benchmarks(metrics: DataFrame, lower: Column) -> DataFrame:
    """By run and metric: the target's number, and the best, any and all of usable competitors."""
    rival = (F.col("input_order") > 0) & F.col("usable")
    return metrics.groupBy("run_id", "metric").agg(
        F.max(F.when(F.col("input_order") == 0, F.col("number"))).alias("target"), F.max(F.when(F.col("input_order") == 0, F.col("usable"))).alias("target_usable"),
        F.max(F.when(rival, F.col("number"))).alias("high"), F.min(F.when(rival, F.col("number"))).alias("low"), F.count_if(rival).alias("rivals"),
    ).withColumn("benchmark", F.when(lower, F.col("low")).otherwise(F.col("high")))


def _rules(spark: SparkSession) -> DataFrame:
    rows = [(f"GAP_{n}", f"ADV_{n}", m, float(t), low, p, e) for n, m, t, low, p, e in SCALAR] + [(f"GAP_{g}", f"ADV_{a}", m, 1.0, False, p, "medium") for g, a, m, p in BOOLEAN]
    common = {m: (r, p) for r, m, p in SHARED}
    return spark.createDataFrame([(*r, *common.get(r[2], (None, None))) for r in rows], "gap_rule string, adv_rule string, metric string, threshold double, lower boolean, priority string, effort string, shared_rule string, shared_priority string")


def conclusions(metrics: DataFrame) -> DataFrame:
    """``run_id, kind, rule_id, metric, target, benchmark, priority, effort``: gaps, advantages and shared gaps.

    Runs whose target is unusable, or that have no usable competitor, have no conclusions.
    """
    spark = metrics.sparkSession
    flags = [m for _, _, m, _ in BOOLEAN]
    numbers = metrics.withColumn("number", F.when(F.col("metric").isin(flags), (F.col("number") > 0).cast("double")).otherwise(F.col("number")))
    lower = F.col("metric").isin([m for _, m, _, low, _, _ in SCALAR if low])
    marks = benchmarks(numbers.where(F.col("metric").isin(*RULED)), lower).where("target_usable and rivals > 0")
    judged = marks.join(F.broadcast(_rules(spark)), "metric").withColumn("signed", F.when(F.col("lower"), F.col("target") - F.col("benchmark")).otherwise(F.col("benchmark") - F.col("target")))
    row = lambda kind, rule, priority, effort: F.struct(F.lit(kind).alias("kind"), rule.alias("rule_id"), priority.alias("priority"), effort.alias("effort"))
    all_of = F.array_compact(
        F.array(
            F.when(F.col("signed") >= F.col("threshold"), row("gap", F.col("gap_rule"), F.col("priority"), F.col("effort"))),
            F.when(-F.col("signed") >= F.col("threshold"), row("advantage", F.col("adv_rule"), F.lit("low"), F.lit("low"))),
            F.when(F.col("shared_rule").isNotNull() & (F.col("target") == 0) & (F.col("high") == 0), row("shared", F.col("shared_rule"), F.col("shared_priority"), F.lit("medium"))),
        )
    )
    return judged.select("run_id", "metric", "target", "benchmark", F.explode(all_of).alias("c")).select("run_id", "c.kind", "c.rule_id", "metric", "target", "benchmark", "c.priority", "c.effort")


def status(sites: DataFrame) -> DataFrame:
    """By run: unavailable, partial or complete. ``eligibility`` is one of eligible, degraded, ineligible."""
    target = F.max(F.when(F.col("input_order") == 0, F.col("usable")))
    rivals = F.count_if((F.col("input_order") > 0) & F.col("usable"))
    clean = F.bool_and(F.col("eligibility") == "eligible")
    return sites.groupBy("run_id").agg(F.when(~F.coalesce(target, F.lit(False)) | (rivals == 0), "unavailable").when(clean, "complete").otherwise("partial").alias("status"))


def set_gaps(values: DataFrame) -> DataFrame:
    """Values (``run_id, input_order, metric, value``) that competitors have and the target lacks, ignoring case and outer space."""
    folded = values.withColumn("folded", F.lower(F.btrim("value"))).where("folded <> ''")
    by = folded.groupBy("run_id", "metric", "folded").agg(F.min("input_order").alias("first"), F.count_distinct("input_order").alias("sites"))
    return by.where("first > 0").select("run_id", "metric", F.col("folded").alias("value"), "sites")


# Rules of values that only competitors have, by metric.
COMPETITOR_ONLY = {"schemaTypes": "GAP_COMPETITOR_ONLY_SCHEMA", "topicTerms": "GAP_COMPETITOR_ONLY_TOPICS", "detectedQuestions": "GAP_COMPETITOR_ONLY_QUESTIONS"}


def site_values(sites: DataFrame) -> DataFrame:
    """``run_id, input_order, usable, metric, value``: schema types, topic terms and detected questions of analysed sites."""
    made = [F.struct(F.lit(m).alias("metric"), v.alias("vs")) for m, v in (("schemaTypes", F.col("schema_types")), ("topicTerms", topics()), ("detectedQuestions", F.col("detected_questions")))]
    return sites.select("run_id", "input_order", "usable", F.inline(F.array(*made))).select("run_id", "input_order", "usable", "metric", F.explode_outer("vs").alias("value"))


def competitor_only(values: DataFrame) -> DataFrame:
    """``run_id, kind, rule_id, metric, missing, priority, effort``: one gap for each metric in which usable competitors have
    values that the target lacks. Sites without values have a row with a null value; runs without a usable target or competitor have no gap."""
    target, rival = F.col("input_order") == 0, (F.col("input_order") > 0) & F.col("usable")
    fit = values.groupBy("run_id").agg(F.bool_or(target & F.col("usable")).alias("t"), F.bool_or(rival).alias("r")).where("t and r").select("run_id")
    only = set_gaps(values.where(target | rival)).join(fit, "run_id", "left_semi")
    rule = F.create_map(*[F.lit(x) for m in COMPETITOR_ONLY.items() for x in m])
    found = only.groupBy("run_id", "metric").agg(F.array_sort(F.collect_list("value")).alias("missing"))
    return found.select("run_id", F.lit("gap").alias("kind"), rule[F.col("metric")].alias("rule_id"), "metric", "missing", F.lit("medium").alias("priority"), F.lit("medium").alias("effort"))


def every_conclusion(sites: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """All conclusions of analysed sites, gaps of values that only competitors have among them, with ``category``, ``confidence`` and ``missing`` values."""
    plain = conclusions(long_metrics(sites) if metrics is None else metrics)
    return described(plain.unionByName(competitor_only(site_values(sites)), allowMissingColumns=True))


def proposals(gaps: DataFrame) -> DataFrame:
    """One artifact for each gap, typed by its metric; ``review`` tells whether editors suffice or a qualified professional is needed."""
    kind = F.when(category(F.col("metric")) == "trust", "references-and-risk-section").otherwise("comparison-table")
    for artifact, metrics in ARTIFACTS.items():
        kind = F.when(F.col("metric").isin(*metrics), artifact).otherwise(kind)
    made = gaps.where("kind = 'gap'").select("run_id", F.concat(F.lit("PROPOSAL_"), "rule_id").alias("artifact_id"), F.lit("1.0.0").alias("artifact_version"), "rule_id", "metric", kind.alias("artifact_type"), F.lit("proposal").alias("status"), "priority", "effort")
    return made.withColumn("review", F.when(F.col("artifact_type").isin(*PROFESSIONAL), "professional").otherwise("editorial"))


def category(metric: Column) -> Column:
    out = F.lit("technical")
    for m, c in CATEGORIES.items():
        out = F.when(metric == m, F.lit(c)).otherwise(out)
    return out


def described(found: DataFrame) -> DataFrame:
    """Conclusions with ``category``, and ``confidence``: medium where values that only competitors have were found, else high."""
    sets = F.col("rule_id").isin(*COMPETITOR_ONLY.values())
    return found.withColumns({"category": category(F.col("metric")), "confidence": F.when(sets, "medium").otherwise("high")})
