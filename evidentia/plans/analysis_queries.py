"""Queries over page analyses made of ``orders``: every rule and analyzer meets each of its cases, whatever the pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import artifacts, compare, crawl, evidence, page_analysis, rules

_TYPES = ("[]", '["Organization"]', '["LocalBusiness", "Thing"]', '["BreadcrumbList"]', '["DENTIST", "breadcrumblist"]')


def _analyses(spark: SparkSession, sf_dir: str, by_run: bool = False) -> DataFrame:
    pick = lambda values, by: f"element_at(array({', '.join(map(repr, values))}), cast({by} + 1 AS int))"
    copies = lambda value, n: F.expr(f"array_repeat({value}, cast({n} AS int))")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 4").alias("run_id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    o = evidence.together(o, "run_id") if by_run else o
    made = o.selectExpr(
        "k AS page_id", "concat('https://made.example/', k) AS url", "concat('https://made.example/', k) AS requested_url", f"{pick((200, 199, 301, 404, 299), 'k % 5')} AS status_code", "k % 3 AS redirect_count",
        "c % 4 <> 0 AS robots_txt_available", "c % 5 <> 0 AS sitemap_xml_available", "404 AS robots_txt_status_code", "500 AS sitemap_xml_status_code",
        f"{pick(('explicit-noindex', 'explicit-index', 'not-specified'), 'c % 3')} AS indexability", "c % 3 <> 0 AS is_indexable", "'none' AS robots_meta", "array('none') AS directives",
        f"{pick(('missing', 'mismatch', 'invalid', 'match'), 'k % 4')} AS canonical_status", "'/x' AS canonical_href", "'https://made.example/x' AS canonical_url",
        f"{pick((0, 1, 29, 30, 60, 61, 90), 'k % 7')} AS title_length", "'t' AS title", f"{pick((0, 1, 69, 70, 160, 161), 'k % 6')} AS meta_description_length", "'d' AS meta_description",
        "nullif(cast(c % 6 AS string), '0') AS document_language", "c % 7 <> 0 AS viewport_present", "k div 4 % 3 AS h1_count", "k div 4 % 3 + c % 2 AS heading_count", "c % 2 AS empty_heading_count", "array('h') AS h1_text",
        "c % 2 = 0 AS is_home", "c % 2 AS entity_count", "c div 2 % 2 AS service_count", "c div 4 % 2 AS location_count", "c div 8 % 2 AS contact_count", "k div 2 % 5 AS internal_link_count", "c % 3 AS image_count",
        "least(c % 3, k % 3) AS images_missing_alt", "k % 3 AS empty_anchor_count", "k div 3 % 3 AS question_count", "array('q') AS detected_questions", "k div 2 % 2 AS direct_answer_count", f"{pick((0, 99, 100), 'k % 3')} AS word_count",
        "'' AS visible_text", "least(k % 3, c % 3) AS jsonld_error_count", f"from_json({pick(_TYPES, 'k div 7 % 5')}, 'array<string>') AS schema_types",
        "filter(array('services', concat('topic ', c % 9)), x -> k % 2 = 0) AS section_terms", "c div 5 % 2 AS trust_count", "c % 4 AS external_link_count", "run_id", "k", "c",
    )
    terms = {f"{n}_terms": copies(f"'{n}'", f"{n}_count") for n in ("entity", "service", "location", "contact")}
    block, image = "named_struct('raw', 'x', 'valid', {})", "named_struct('src', 's', 'url', 'u', 'alt', {})"
    link = "named_struct('href', '/x', 'url', 'u', 'host', 'made.example', 'internal', true, 'text', '{}')"
    return made.withColumns(
        terms | {
            "level_jumps": copies("1", "k div 3 % 2"), "repeated_headings": copies("1", "k div 5 % 2"), "breadcrumbs": copies("'b'", "c div 3 % 2"), "external_domains": copies("'d'", "k % 2"), "faq_indicators": copies("'f'", "c % 4"), "internal_urls": copies("'u'", "c % 8"),
            "json_ld": F.concat(copies(block.format("false"), "jsonld_error_count"), copies(block.format("true"), "k % 3 - jsonld_error_count")),
            "images": F.concat(copies(image.format("' '"), "images_missing_alt"), copies(image.format("'a'"), "image_count - images_missing_alt")),
            "links": F.concat(copies(link.format(""), "empty_anchor_count"), copies(link.format("t"), "1")),
            "has_identity_type": F.exists("schema_types", lambda t: F.lower(t).isin(*page_analysis.IDENTITY_TYPES)),
        }
    )


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.findings(_analyses(spark, sf_dir))
    return found.select("page_id", "rule_id", "category", "priority", "effort", "classification", "confidence", F.array_join(F.transform("evidence", lambda x: x["field"]), ",").alias("fields"))


def analyzer_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by observation; the analyzers of words see empty texts."""
    return rules.observations(_analyses(spark, sf_dir)).groupBy("group", "analyzer_id", "label", "field", "status").agg(F.count("*").alias("pages"))


def crawl_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl whose analysed pages have odd keys or keys that 4 divides."""
    a = _analyses(spark, sf_dir)
    outcome = F.when((F.col("k") % 2 == 1) | (F.col("k") % 4 == 0), "analyzed").when(F.col("c") % 3 == 0, "blocked").when(F.col("c") % 3 == 1, "skipped").otherwise("error")
    a = a.withColumn("outcome", outcome)
    seen = a.where("outcome = 'analyzed'")
    out = crawl.aggregate(a, seen, rules.finding_ids(seen))
    joined = {n: F.array_join(n, "|") for n in ("schema_types", "section_terms")} | {"finding_counts": F.array_join(F.transform("finding_counts", lambda x: F.concat_ws("=", x["rule_id"], x["pages"])), "|")}
    return out.withColumns(joined)


def _sites(spark: SparkSession, sf_dir: str, by_run: bool = False) -> DataFrame:
    """Runs of four sites by key; some can't be used. ``by_run`` brings the sites of a run together before anything is made of them."""
    return _analyses(spark, sf_dir, by_run).selectExpr("*", "k % 4 AS input_order", "c % 7 <> 0 AS usable")


def comparison_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 43 metrics: their sums over sites, and the distinct labels of text metrics."""
    m = compare.long_metrics(_sites(spark, sf_dir))
    return m.groupBy("metric").agg(F.count("*").alias("sites"), F.sum("number").cast("long").alias("total"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


def comparison_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar, boolean and shared rule, with category and confidence."""
    found = compare.described(compare.conclusions(compare.long_metrics(_sites(spark, sf_dir))))
    return found.withColumns({c: F.col(c).cast("long") for c in ("target", "benchmark")})


def comparison_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.conclusions(compare.long_metrics(_sites(spark, sf_dir)))
    return compare.proposals(found).select("run_id", "artifact_id", "metric", "artifact_type", "review", "status", "priority", "effort")


def gap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundles of each conclusion: who stands in them, what was seen there, and which are benchmarks."""
    sites = _sites(spark, sf_dir, by_run=True)
    found = compare.conclusions(compare.long_metrics(sites, compare.RULED)).withColumn("missing", F.lit(None).cast("array<string>"))
    out = evidence.bundles(found, sites)
    seen = lambda f: F.array_join(F.transform("competitors", f), ",")
    return out.select(
        "run_id", "kind", "rule_id", F.get("target_evidence", 0)["value"].alias("target"), F.get("target_evidence", 0)["selector"].alias("selector"), seen(lambda b: b["input_order"].cast("string")).alias("orders"),
        seen(lambda b: b["observed_value"]).alias("observed"), seen(lambda b: b["benchmark"].cast("string")).alias("benchmarks"),
    )


def evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles that don't hold, after some were tampered with: of runs that 10 divides the first competitor's is lost, of others that 15 divides no benchmark is marked."""
    sites = _sites(spark, sf_dir, by_run=True)
    found = compare.conclusions(compare.long_metrics(sites, compare.RULED)).withColumn("missing", F.lit(None).cast("array<string>"))
    plain = F.transform("competitors", lambda b: b.withField("benchmark", F.lit(False)))
    lost = F.when(F.col("run_id") % 10 == 0, F.slice("competitors", 2, 10)).when(F.col("run_id") % 15 == 5, plain).otherwise(F.col("competitors"))
    return evidence.incomplete(evidence.bundles(found, sites).withColumn("competitors", lost), sites).groupBy("rule_id", "problem").agg(F.count("*").alias("runs"))


def proposal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.conclusions(compare.long_metrics(_sites(spark, sf_dir)))
    made = artifacts.written(compare.proposals(found), found)
    told = F.regexp_extract("draft", "Seen: ([^\n]*)", 1)
    by = made.groupBy("artifact_type", "review", F.size("facts_to_confirm").cast("long").alias("facts"), told.alias("difference"))
    return by.agg(F.count("*").alias("proposals"), F.count_if(F.col("draft").contains("{") & (F.col("artifact_type") == "page-brief")).alias("open"))


QUERIES = {f.__name__: f for f in (rule_findings, analyzer_statuses, crawl_rollup, comparison_metrics, comparison_rules, comparison_proposals, gap_evidence, evidence_problems, proposal_texts)}

_MADE = """m AS (SELECT o_orderkey AS k, o_custkey AS c, [200, 199, 301, 404, 299][k % 5 + 1] AS status, ['missing', 'mismatch', 'invalid', 'match'][k % 4 + 1] AS canon, [0, 1, 29, 30, 60, 61, 90][k % 7 + 1] AS title,
 [0, 1, 69, 70, 160, 161][k % 6 + 1] AS des, k // 4 % 3 AS h1, c % 2 AS entity, c // 2 % 2 AS service, c // 4 % 2 AS location, c // 8 % 2 AS contact, k // 2 % 5 AS internal, least(c % 3, k % 3) AS bad, k // 3 % 3 AS questions,
 k // 2 % 2 AS answers, [0, 99, 100][k % 3 + 1] AS words, k // 7 % 5 AS t FROM orders)"""
_H, _M, _L = "high", "medium", "low"
#: Rule, category, priority, effort, heuristic, fields of its evidence (one of them per faulty item where there is a count), condition.
_RULES = (
    ("HTTP_NON_2XX", "crawl-indexability", _H, _M, 0, "statusCode", "", "status NOT BETWEEN 200 AND 299"),
    ("REDIRECT_OBSERVED", "crawl-indexability", _M, _L, 0, "normalizedUrl,finalUrl,redirectCount", "", "k % 3 > 0"),
    ("ROBOTS_TXT_MISSING", "crawl-indexability", _M, _L, 0, "robotsTxtStatusCode", "", "c % 4 = 0"),
    ("SITEMAP_XML_MISSING", "crawl-indexability", _M, _L, 0, "sitemapXmlStatusCode", "", "c % 5 = 0"),
    ("INDEXABILITY_NOINDEX", "crawl-indexability", _H, _L, 0, "robotsDirectives", "", "c % 3 = 0"),
    ("CANONICAL_MISSING", "crawl-indexability", _H, _L, 0, "canonicalStatus", "", "canon = 'missing'"),
    ("CANONICAL_MISMATCH", "crawl-indexability", _H, _L, 0, "canonicalResolvedUrl,finalUrl", "", "canon = 'mismatch'"),
    ("CANONICAL_INVALID", "crawl-indexability", _H, _L, 0, "canonicalUrl", "", "canon = 'invalid'"),
    ("TITLE_MISSING", "metadata", _H, _L, 0, "title", "", "title = 0"),
    ("TITLE_LENGTH_SHORT", "metadata", _L, _L, 1, "titleLength,title", "", "title IN (1, 29)"),
    ("TITLE_LENGTH_LONG", "metadata", _L, _L, 1, "titleLength,title", "", "title IN (61, 90)"),
    ("META_DESCRIPTION_MISSING", "metadata", _M, _L, 0, "metaDescription", "", "des = 0"),
    ("META_DESCRIPTION_LENGTH_SHORT", "metadata", _L, _L, 1, "metaDescriptionLength,metaDescription", "", "des IN (1, 69)"),
    ("META_DESCRIPTION_LENGTH_LONG", "metadata", _L, _L, 1, "metaDescriptionLength,metaDescription", "", "des = 161"),
    ("DOCUMENT_LANGUAGE_MISSING", "metadata", _M, _L, 0, "documentLanguage", "", "c % 6 = 0"),
    ("VIEWPORT_MISSING", "metadata", _M, _L, 0, "viewportPresent", "", "c % 7 = 0"),
    ("HEADING_MISSING_H1", "heading-structure", _H, _L, 0, "h1Count", "", "h1 = 0"),
    ("HEADING_MULTIPLE_H1", "heading-structure", _M, _M, 0, "h1Text", "", "h1 = 2"),
    ("HEADING_EMPTY", "heading-structure", _M, _L, 0, "emptyHeadingCount", "", "c % 2 = 1"),
    ("HEADING_LEVEL_JUMP", "heading-structure", _M, _L, 0, "headingLevelJumps", "", "k // 3 % 2 = 1"),
    ("HEADING_REPEATED_TEXT", "heading-structure", _L, _M, 0, "repeatedHeadings", "", "k // 5 % 2 = 1"),
    ("JSONLD_MISSING", "structured-data", _M, _M, 0, "jsonLdRawBlocks", "", "k % 3 = 0"),
    ("JSONLD_INVALID", "structured-data", _H, _L, 0, "jsonLdParseErrors", "bad", "bad > 0"),
    ("IDENTITY_SCHEMA_MISSING", "structured-data", _M, _M, 1, "schemaTypes,coverage", "", "c % 2 = 0 AND entity + service + location + contact > 0 AND t IN (0, 3)"),
    ("BREADCRUMB_SCHEMA_MISSING", "structured-data", _L, _M, 1, "breadcrumbIndicators,schemaTypes", "", "c % 2 = 1 AND c // 3 % 2 = 1 AND t < 3"),
    ("INTERNAL_LINKS_MISSING", "links-media", _H, _M, 0, "internalLinkCount", "", "internal = 0"),
    ("INTERNAL_LINKS_LOW", "links-media", _L, _L, 1, "internalLinkCount", "", "internal IN (1, 2)"),
    ("IMAGE_ALT_MISSING", "links-media", _M, _L, 0, "imageAltIssues", "bad", "bad > 0"),
    ("EMPTY_ANCHOR_TEXT", "links-media", _M, _L, 0, "links", "k % 3", "k % 3 > 0"),
    ("DIRECT_ANSWER_MISSING", "answerability", _M, _M, 1, "detectedQuestions,directAnswerCount", "", "questions > 0 AND answers = 0"),
    ("ENTITY_COVERAGE_MISSING", "entity-coverage", _M, _M, 1, "coverage.entity", "", "service + location + contact > 0 AND entity = 0"),
    ("SERVICE_COVERAGE_MISSING", "entity-coverage", _M, _M, 1, "coverage.service", "", "c % 2 = 0 AND words = 100 AND entity + contact > 0 AND service = 0"),
    ("LOCATION_COVERAGE_MISSING", "entity-coverage", _M, _M, 1, "coverage.location", "", "t IN (2, 4) AND location = 0"),
    ("CONTACT_SIGNALS_MISSING", "entity-coverage", _M, _M, 1, "coverage.contact", "", "t IN (2, 4) AND contact = 0"),
)
_FOUND = " UNION ALL ".join(
    f"SELECT k AS page_id, c, '{r}' AS rule_id, '{cat}' AS category, '{p}' AS priority, '{e}' AS effort, {h} AS h, {f"rtrim(repeat('{f},', ({n})::INT), ',')" if n else f"'{f}'"} AS fields FROM m WHERE {w}" for r, cat, p, e, h, f, n, w in _RULES
)
_OBSERVED, _PART, _NOT, _REVIEW, _NONE = "'observed'", "'partially-observed'", "'not-observed'", "'needs-human-review'", "'not-applicable'"
_EITHER = lambda when, then, other: f"CASE WHEN {when} THEN {then} ELSE {other} END"
#: Group, analyzer, label, field, status.
_STATUSES = (
    ("technical", "TECH_HTTP_STATUS", "HTTP retrieval", "statusCode", _EITHER("status BETWEEN 200 AND 299", _OBSERVED, _PART)),
    ("technical", "TECH_INDEXABILITY", "Indexability directives", "indexability", _EITHER("c % 3 <> 0", _OBSERVED, _PART)),
    ("technical", "TECH_CANONICAL", "Canonical relationship", "canonicalStatus", _EITHER("canon = 'match'", _OBSERVED, _PART)),
    ("technical", "TECH_HEADING_STRUCTURE", "Heading structure", "headingHierarchy", _EITHER("h1 = 1 AND k // 3 % 2 = 0", _OBSERVED, _PART)),
    ("technical", "TECH_IMAGE_ALT", "Image alternative text", "imageAltIssues", _EITHER("c % 3 = 0", _NONE, _EITHER("bad = 0", _OBSERVED, _PART))),
    ("technical", "TECH_STRUCTURED_DATA", "Structured data", "schemaTypes", _EITHER("t = 0", _NOT, _EITHER("bad > 0", _PART, _OBSERVED))),
    ("content-answerability", "CONTENT_QUESTIONS", "Visible questions", "detectedQuestions", _EITHER("questions > 0", _OBSERVED, _NOT)),
    ("content-answerability", "CONTENT_DIRECT_ANSWERS", "Answer proximity", "directAnswers", _EITHER("questions = 0", _NONE, _EITHER("answers > 0", _OBSERVED, _NOT))),
    ("entities", "ENTITY_ORGANIZATION", "Organization or brand", "coverage.entity", _EITHER("entity > 0", _OBSERVED, _NOT)),
    ("entities", "ENTITY_SERVICE", "Services", "coverage.service", _EITHER("service > 0", _OBSERVED, _NOT)),
    ("entities", "ENTITY_LOCATION", "Locations", "coverage.location", _EITHER("location > 0", _OBSERVED, _NOT)),
    ("entities", "ENTITY_CONTACT", "Contact identity", "coverage.contact", _EITHER("contact > 0", _OBSERVED, _NOT)),
    ("entities", "ENTITY_SCHEMA_VISIBLE_CONSISTENCY", "Schema-to-visible consistency", "coverage", _EITHER("t > 0 AND entity > 0", _PART, _REVIEW)),
    ("retrieval-support", "RETRIEVAL_EXTRACTABLE_ANSWERS", "Extractable answers", "directAnswers", _EITHER("answers > 0", _OBSERVED, _EITHER("questions > 0", _PART, _NOT))),
    ("retrieval-support", "RETRIEVAL_SECTION_CLARITY", "Section clarity", "headingHierarchy", _EITHER("h1 + c % 2 > 1", _OBSERVED, _PART)),
    ("retrieval-support", "RETRIEVAL_ENTITY_NAMING", "Entity naming", "coverage.entity", _EITHER("entity > 0", _OBSERVED, _NOT)),
    ("retrieval-support", "RETRIEVAL_EVIDENCE_DENSITY", "Evidence density", "contentCounts", _EITHER("words > 0", _PART, _NOT)),
    *[("content-answerability", f"CONTENT_{n}", label, "visibleText", s) for n, label, s in (("PRICING", "Pricing", _NOT), ("INSURANCE", "Insurance", _NOT), ("PROCESS", "Process", _NOT), ("RISKS", "Risks and limitations", _REVIEW),
      ("ALTERNATIVES", "Alternatives", _REVIEW), ("ELIGIBILITY", "Eligibility", _REVIEW), ("REVIEW_DATE", "Freshness or review date", _NOT))],
    ("entities", "ENTITY_PROVIDER", "Provider or author", "visibleText", _REVIEW),
    *[("trust-ymyl", f"TRUST_{n}", label, "visibleText", s) for n, label, s in (("CREDENTIALS", "Credentials language", _REVIEW), ("MEDICAL_REVIEW", "Medical review", _REVIEW), ("CITATIONS", "References or citations", _REVIEW),
      ("POLICIES", "Policies", _NOT), ("TESTIMONIALS", "Testimonials or cases", _REVIEW), ("ASSOCIATIONS", "Associations or publications", _REVIEW), ("FINANCING", "Financing", _REVIEW))],
    ("retrieval-support", "RETRIEVAL_DEFINITIONS", "Definitions", "visibleText", _NOT),
)
_SEEN = " UNION ALL ".join(f"SELECT '{g}' AS \"group\", '{a}' AS analyzer_id, '{label}' AS label, '{f}' AS field, {s} AS status FROM m" for g, a, label, f, s in _STATUSES)
#: Metrics by their number, then those that are labels.
_NUMBERS = {
    "statusCode": "status", "redirectCount": "k % 3", "indexable": "(status BETWEEN 200 AND 299 AND c % 3 <> 0)::INT", "robotsTxtAvailable": "(c % 4 <> 0)::INT", "robotsTxtStatusCode": "404", "sitemapXmlAvailable": "(c % 5 <> 0)::INT",
    "sitemapXmlStatusCode": "500", "hasTitle": "(title > 0)::INT", "titleLength": "title", "hasMetaDescription": "(des > 0)::INT", "descriptionLength": "des", "canonicalMatches": "(canon = 'match')::INT", "hasLanguage": "(c % 6 <> 0)::INT",
    "viewportPresent": "(c % 7 <> 0)::INT", "h1Count": "h1", "h1StructureValid": "(h1 = 1)::INT", "totalHeadingCount": "h1 + c % 2", "headingJumpCount": "k // 3 % 2", "emptyHeadingCount": "c % 2", "repeatedHeadingCount": "k // 5 % 2",
    "wordCount": "words", "questionCount": "questions", "faqIndicatorCount": "c % 4", "directAnswerCount": "answers", "schemaTypeCount": "[0, 1, 2, 1, 2][t + 1]", "jsonLdParseErrorCount": "bad", "internalLinkCount": "internal",
    "uniqueInternalUrlCount": "c % 8", "externalLinkCount": "c % 4", "uniqueExternalDomainCount": "k % 2", "imageCount": "c % 3", "imagesMissingAltCount": "bad", "emptyAnchorCount": "k % 3",
    "topicTermCount": "CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + entity + service + location", "serviceTermCount": "service", "locationTermCount": "location", "hasIdentitySignals": "entity", "hasTrustSignals": "c // 5 % 2",
    "hasContactSignals": "contact", "hasLocationSignals": "location",
}
_LABELS = {"indexabilityStatus": "['explicit-noindex', 'explicit-index', 'not-specified'][c % 3 + 1]", "canonicalStatus": "canon", "documentLanguage": "nullif((c % 6)::VARCHAR, '0')"}
_METRICS = f"""{_MADE}, x AS (SELECT k, c, unnest([{', '.join(f"{{'m': '{n}', 'v': ({v})::BIGINT, 'l': NULL::VARCHAR}}" for n, v in _NUMBERS.items())}, {', '.join(f"{{'m': '{n}', 'v': NULL::BIGINT, 'l': {v}}}" for n, v in _LABELS.items())}]) AS x FROM m),
mm AS (SELECT k // 4 AS run_id, k % 4 AS o, c % 7 <> 0 AS ok, x.m AS metric, x.v AS v, x.l AS l FROM x)"""
#: Suffix of a gap and of an advantage, metric, least difference (negative: lower is better), priority, effort, category, artifact.
_COMPARED = (
    ("HEADING_COVERAGE", "", "totalHeadingCount", 2, _M, _M, "retrieval-support", "heading-structure"), ("CONTENT_BREADTH", "", "wordCount", 100, _M, _H, "content", "page-brief"),
    ("QUESTION_COVERAGE", "", "questionCount", 1, _M, _M, "answerability", "visible-faq-and-jsonld"), ("DIRECT_ANSWERS", "", "directAnswerCount", 1, _M, _M, "answerability", "visible-faq-and-jsonld"),
    ("INTERNAL_LINKS", "", "internalLinkCount", 3, _M, _L, "retrieval-support", "internal-links"), ("SERVICE_CLARITY", "", "serviceTermCount", 1, _M, _M, "content", "page-brief"),
    ("LOCATION_CLARITY", "", "locationTermCount", 1, _M, _L, "entity", "trust-or-contact-block"), ("IMAGE_ALT", "", "imagesMissingAltCount", -1, _M, _L, "technical", "image-alt-guidance"),
    ("HEADING_JUMPS", "", "headingJumpCount", -1, _L, _L, "technical", "heading-structure"), ("EMPTY_HEADINGS", "", "emptyHeadingCount", -1, _L, _L, "technical", "heading-structure"),
    ("REPEATED_HEADINGS", "", "repeatedHeadingCount", -1, _L, _L, "technical", "heading-structure"), ("EMPTY_ANCHORS", "", "emptyAnchorCount", -1, _L, _L, "technical", "internal-links"),
    ("JSONLD_ERRORS", "", "jsonLdParseErrorCount", -1, _H, _L, "schema", "structured-data"),
    ("INDEXABILITY", "", "indexable", 1, _H, _M, "technical", "comparison-table"), ("TITLE_MISSING", "TITLE_PRESENT", "hasTitle", 1, _H, _M, "technical", "title"),
    ("CANONICAL_MISMATCH", "CANONICAL_MATCH", "canonicalMatches", 1, _H, _M, "technical", "canonical"), ("IDENTITY_SIGNALS", "", "hasIdentitySignals", 1, _H, _M, "entity", "provider-or-reviewer-block"),
    ("DESCRIPTION_MISSING", "DESCRIPTION_PRESENT", "hasMetaDescription", 1, _M, _M, "technical", "meta-description"), ("VIEWPORT_MISSING", "VIEWPORT_PRESENT", "viewportPresent", 1, _M, _M, "technical", "comparison-table"),
    ("H1_STRUCTURE", "", "h1StructureValid", 1, _M, _M, "technical", "heading-structure"), ("FAQ_STRUCTURE", "", "faqIndicatorCount", 1, _M, _M, "answerability", "visible-faq-and-jsonld"),
    ("TRUST_SIGNALS", "", "hasTrustSignals", 1, _M, _M, "trust", "provider-or-reviewer-block"), ("CONTACT_SIGNALS", "", "hasContactSignals", 1, _M, _M, "entity", "trust-or-contact-block"),
    ("LOCATION_SIGNALS", "", "hasLocationSignals", 1, _M, _M, "entity", "trust-or-contact-block"), ("LANGUAGE_MISSING", "LANGUAGE_PRESENT", "hasLanguage", 1, _L, _M, "technical", "comparison-table"),
)
_COMMON = (("DESCRIPTION_MISSING", "hasMetaDescription", _M), ("IDENTITY_SIGNALS", "hasIdentitySignals", _H), ("TRUST_SIGNALS", "hasTrustSignals", _M), ("CONTACT_SIGNALS", "hasContactSignals", _M))
_CONCLUSIONS = f"""{_METRICS}, rules(gap, adv, metric, least, priority, effort, category, artifact) AS (VALUES {', '.join(str((f'GAP_{g}', f'ADV_{a or g}', *rest)) for g, a, *rest in _COMPARED)}),
common(rule_id, metric, priority) AS (VALUES {', '.join(str((f'SHARED_GAP_{r}', m, p)) for r, m, p in _COMMON)}),
n AS (SELECT run_id, o, ok, metric, CASE WHEN metric = 'faqIndicatorCount' THEN (v > 0)::BIGINT ELSE v END AS v FROM mm),
b AS (SELECT run_id, metric, max(v) FILTER (o = 0) AS target, max(v) FILTER (o > 0 AND ok) AS hi, min(v) FILTER (o > 0 AND ok) AS lo FROM n GROUP BY ALL HAVING bool_or(o = 0 AND ok) AND bool_or(o > 0 AND ok)),
d AS (SELECT *, CASE WHEN least < 0 THEN lo ELSE hi END AS benchmark, CASE WHEN least < 0 THEN target - lo ELSE hi - target END AS diff FROM b JOIN rules USING (metric)),
f AS (SELECT run_id, 'gap' AS kind, gap AS rule_id, metric, target, benchmark, priority, effort, category, artifact FROM d WHERE diff >= abs(least)
 UNION ALL SELECT run_id, 'advantage', adv, metric, target, benchmark, 'low', 'low', category, artifact FROM d WHERE -diff >= abs(least)
 UNION ALL SELECT run_id, 'shared', common.rule_id, metric, target, hi, common.priority, 'medium', rules.category, NULL FROM b JOIN common USING (metric) JOIN rules USING (metric) WHERE target = 0 AND hi = 0)"""
_FLAGS = "('indexable', 'robotsTxtAvailable', 'sitemapXmlAvailable', 'hasTitle', 'hasMetaDescription', 'canonicalMatches', 'hasLanguage', 'viewportPresent', 'h1StructureValid', 'hasIdentitySignals', 'hasTrustSignals', 'hasContactSignals', 'hasLocationSignals')"
#: Selector of each metric that a rule names.
_SELECTED = {
    "title": ("hasTitle",), 'meta[name="description"]': ("hasMetaDescription",), 'link[rel="canonical"]': ("canonicalMatches",), "html": ("hasLanguage",), 'meta[name="viewport"]': ("viewportPresent",), "h1": ("h1StructureValid",), "img": ("imagesMissingAltCount",),
    "h1, h2, h3, h4, h5, h6": ("totalHeadingCount", "headingJumpCount", "emptyHeadingCount", "repeatedHeadingCount"), "a[href]": ("internalLinkCount", "emptyAnchorCount"), 'script[type="application/ld+json"]': ("jsonLdParseErrorCount",),
    "body": ("wordCount", "questionCount", "faqIndicatorCount", "directAnswerCount", "serviceTermCount", "locationTermCount"),
}
_EVIDENCE = f"""{_CONCLUSIONS}, said AS (SELECT mm.run_id, mm.o, mm.ok, metric, CASE WHEN metric IN {_FLAGS} THEN (mm.v = 1)::VARCHAR ELSE mm.v::VARCHAR END AS seen, n.v FROM mm JOIN n USING (run_id, o, metric)),
bundles AS (SELECT f.run_id, f.kind, f.rule_id, f.metric, max(seen) FILTER (o = 0) AS target, string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (o > 0 AND ok) AS orders, string_agg(seen, ',' ORDER BY o) FILTER (o > 0 AND ok) AS observed,
 string_agg((s.v = f.benchmark)::VARCHAR, ',' ORDER BY o) FILTER (o > 0 AND ok) AS benchmarks FROM f JOIN said s ON s.run_id = f.run_id AND s.metric = f.metric GROUP BY ALL)"""
ORACLE_SQL = {
    "gap_evidence": f"WITH {_EVIDENCE} SELECT run_id, kind, rule_id, target, CASE {' '.join(f'WHEN metric IN ({", ".join(repr(m) for m in ms)}) THEN {chr(39)}{s}{chr(39)}' for s, ms in _SELECTED.items())} END AS selector, orders, observed, benchmarks FROM bundles",
    "evidence_problems": f"""WITH {_EVIDENCE} SELECT rule_id, CASE WHEN run_id % 10 = 0 THEN 'not one bundle for each usable competitor' ELSE 'no benchmark' END AS problem, count(*) AS runs FROM bundles WHERE run_id % 10 = 0 OR run_id % 15 = 5 GROUP BY ALL""",
    "proposal_texts": f"""WITH {_CONCLUSIONS} SELECT artifact AS artifact_type, CASE WHEN artifact IN ('provider-or-reviewer-block', 'visible-faq-and-jsonld') THEN 'professional' ELSE 'editorial' END AS review,
 CASE WHEN artifact IN ('canonical', 'provider-or-reviewer-block', 'visible-faq-and-jsonld', 'structured-data', 'trust-or-contact-block') THEN 2 ELSE 1 END::BIGINT AS facts,
 CASE WHEN artifact = 'page-brief' THEN 'the target has ' || target || ', the benchmark ' || benchmark ELSE '' END AS difference, count(*) AS proposals, 0::BIGINT AS open FROM f WHERE kind = 'gap' GROUP BY ALL""",
    "comparison_metrics": f"WITH {_METRICS} SELECT metric, count(*) AS sites, sum(v)::BIGINT AS total, coalesce(string_agg(DISTINCT l, '|' ORDER BY l), '') AS labels FROM mm GROUP BY 1",
    "comparison_rules": f"WITH {_CONCLUSIONS} SELECT * EXCLUDE (artifact), 'high' AS confidence FROM f",
    "comparison_proposals": f"""WITH {_CONCLUSIONS} SELECT run_id, 'PROPOSAL_' || rule_id AS artifact_id, metric, artifact AS artifact_type,
 CASE WHEN artifact IN ('provider-or-reviewer-block', 'visible-faq-and-jsonld') THEN 'professional' ELSE 'editorial' END AS review, 'proposal' AS status, priority, effort FROM f WHERE kind = 'gap'""",
    "rule_findings": f"WITH {_MADE}, f AS ({_FOUND}) SELECT page_id, rule_id, category, priority, effort, CASE WHEN h = 1 THEN 'editorial-heuristic' ELSE 'observation' END AS classification, CASE WHEN h = 1 THEN 'medium' ELSE 'high' END AS confidence, fields FROM f",
    "analyzer_statuses": f"WITH {_MADE}, o AS ({_SEEN}) SELECT *, count(*) AS pages FROM o GROUP BY ALL",
    "crawl_rollup": f"""WITH {_MADE}, f AS ({_FOUND}), r AS (SELECT *, CASE WHEN k % 2 = 1 OR k % 4 = 0 THEN 'analyzed' ELSE ['blocked', 'skipped', 'error'][c % 3 + 1] END AS outcome FROM m), a AS (SELECT * FROM r WHERE outcome = 'analyzed'),
n AS (SELECT rule_id, count(DISTINCT page_id) AS n FROM f WHERE page_id IN (SELECT k FROM a) GROUP BY 1),
ty AS (SELECT DISTINCT unnest([[], ['Organization'], ['LocalBusiness', 'Thing'], ['BreadcrumbList'], ['DENTIST', 'breadcrumblist']][t + 1]) AS x FROM a),
tm AS (SELECT DISTINCT unnest(['services', 'topic ' || (c % 9)]) AS x FROM a WHERE k % 2 = 0)
SELECT {', '.join(f"(SELECT count(*) FROM r WHERE outcome = '{x}') AS {x}_pages" for x in ('analyzed', 'blocked', 'skipped', 'error'))}, (SELECT coalesce(sum(words), 0)::BIGINT FROM a) AS total_words,
 (SELECT string_agg(x, '|' ORDER BY x) FROM ty) AS schema_types, (SELECT string_agg(x, '|' ORDER BY x) FROM tm) AS section_terms, (SELECT string_agg(rule_id || '=' || n, '|' ORDER BY n DESC, rule_id) FROM n) AS finding_counts""",
}
