"""Rule findings and analyzer observations: tables of predicates compiled into one array, exploded once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T


class Rule(NamedTuple):
    """A finding where ``when`` holds, with the ``evidence`` it rests on (made by ``_seen``)."""

    rule_id: str
    category: str
    priority: str
    effort: str
    when: Column
    evidence: Column
    heuristic: bool = False


def _seen(field: str, value: Column, selector: str | None = None, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("observed_value"), (F.lit(selector) if selector else none).alias("selector"), (none if snippet is None else snippet).alias("snippet"))


def rules() -> list[Rule]:
    """The 34 rules over a page analysis with coverage; faulty items (JSON-LD blocks, images, links) are one piece of evidence each."""
    c = F.col
    local = F.exists("schema_types", lambda t: F.lower(t).isin("localbusiness", "medicalbusiness", "dentist", "physician"))
    bread = F.exists("schema_types", lambda t: F.lower(t) == "breadcrumblist")
    some = lambda *kinds: F.greatest(*[c(f"{k}_count") for k in kinds]) > 0 if len(kinds) > 1 else c(f"{kinds[0]}_count") > 0
    title, desc, home = c("title_length"), c("meta_description_length"), c("is_home")
    e = lambda *seen: F.array(*seen)
    each = lambda items, bad, seen: F.transform(F.filter(items, bad), seen)
    text = lambda name: F.to_json(c(name))
    kinds = F.to_json(F.struct(*[F.struct((c(f"{k}_count") > 0).alias("present"), c(f"{k}_terms").alias("terms")).alias(k) for k in ("entity", "service", "location", "contact")]))
    dimension = lambda k: e(_seen(f"coverage.{k}", F.to_json(F.struct((c(f"{k}_count") > 0).alias("present"), c(f"{k}_terms").alias("terms")))))
    no_alt = lambda x: x["alt"].isNull() | (F.btrim(x["alt"]) == "")
    alt_issue = lambda x: F.to_json(F.struct(x["src"].alias("src"), F.when(x["alt"].isNull(), "missing-attribute").otherwise("empty-value").alias("issue")))
    heads, ld, canon, robots, desc_meta = "h1, h2, h3, h4, h5, h6", 'script[type="application/ld+json"]', 'link[rel="canonical"]', 'meta[name="robots"]', 'meta[name="description"]'
    crawl, structure, data, links, answers, covers = "crawl-indexability", "heading-structure", "structured-data", "links-media", "answerability", "entity-coverage"
    lengths = lambda name, n, column: e(_seen(f"{name}Length", n), _seen(name, c(column)))
    return [
        Rule("HTTP_NON_2XX", crawl, "high", "medium", (c("status_code") < 200) | (c("status_code") >= 300), e(_seen("statusCode", c("status_code")))),
        Rule("REDIRECT_OBSERVED", crawl, "medium", "low", c("redirect_count") > 0, e(_seen("normalizedUrl", c("requested_url")), _seen("finalUrl", c("url")), _seen("redirectCount", c("redirect_count")))),
        Rule("ROBOTS_TXT_MISSING", crawl, "medium", "low", ~c("robots_txt_available"), e(_seen("robotsTxtStatusCode", c("robots_txt_status_code")))),
        Rule("SITEMAP_XML_MISSING", crawl, "medium", "low", ~c("sitemap_xml_available"), e(_seen("sitemapXmlStatusCode", c("sitemap_xml_status_code")))),
        Rule("INDEXABILITY_NOINDEX", crawl, "high", "low", c("indexability") == "explicit-noindex", e(_seen("robotsDirectives", text("directives"), robots, c("robots_meta")))),
        Rule("CANONICAL_MISSING", crawl, "high", "low", c("canonical_status") == "missing", e(_seen("canonicalStatus", c("canonical_status"), canon))),
        Rule("CANONICAL_MISMATCH", crawl, "high", "low", c("canonical_status") == "mismatch", e(_seen("canonicalResolvedUrl", c("canonical_url"), canon, c("canonical_href")), _seen("finalUrl", c("url")))),
        Rule("CANONICAL_INVALID", crawl, "high", "low", c("canonical_status") == "invalid", e(_seen("canonicalUrl", c("canonical_href"), canon))),
        Rule("TITLE_MISSING", "metadata", "high", "low", title == 0, e(_seen("title", c("title"), "title"))),
        Rule("TITLE_LENGTH_SHORT", "metadata", "low", "low", (title > 0) & (title < 30), lengths("title", title, "title"), True),
        Rule("TITLE_LENGTH_LONG", "metadata", "low", "low", title > 60, lengths("title", title, "title"), True),
        Rule("META_DESCRIPTION_MISSING", "metadata", "medium", "low", desc == 0, e(_seen("metaDescription", c("meta_description"), desc_meta))),
        Rule("META_DESCRIPTION_LENGTH_SHORT", "metadata", "low", "low", (desc > 0) & (desc < 70), lengths("metaDescription", desc, "meta_description"), True),
        Rule("META_DESCRIPTION_LENGTH_LONG", "metadata", "low", "low", desc > 160, lengths("metaDescription", desc, "meta_description"), True),
        Rule("DOCUMENT_LANGUAGE_MISSING", "metadata", "medium", "low", c("document_language").isNull(), e(_seen("documentLanguage", c("document_language"), "html"))),
        Rule("VIEWPORT_MISSING", "metadata", "medium", "low", ~c("viewport_present"), e(_seen("viewportPresent", c("viewport_present"), 'meta[name="viewport"]'))),
        Rule("HEADING_MISSING_H1", structure, "high", "low", c("h1_count") == 0, e(_seen("h1Count", c("h1_count"), "h1"))),
        Rule("HEADING_MULTIPLE_H1", structure, "medium", "medium", c("h1_count") > 1, e(_seen("h1Text", text("h1_text"), "h1"))),
        Rule("HEADING_EMPTY", structure, "medium", "low", c("empty_heading_count") > 0, e(_seen("emptyHeadingCount", c("empty_heading_count"), heads))),
        Rule("HEADING_LEVEL_JUMP", structure, "medium", "low", F.size("level_jumps") > 0, e(_seen("headingLevelJumps", text("level_jumps"), heads))),
        Rule("HEADING_REPEATED_TEXT", structure, "low", "medium", F.size("repeated_headings") > 0, e(_seen("repeatedHeadings", text("repeated_headings"), heads))),
        Rule("JSONLD_MISSING", data, "medium", "medium", F.size("json_ld") == 0, e(_seen("jsonLdRawBlocks", F.lit("[]"), ld))),
        Rule("JSONLD_INVALID", data, "high", "low", c("jsonld_error_count") > 0, each("json_ld", lambda b: ~b["valid"], lambda b: _seen("jsonLdParseErrors", b["raw"], ld, F.substring(b["raw"], 1, 240)))),
        Rule("IDENTITY_SCHEMA_MISSING", data, "medium", "medium", home & some("entity", "service", "location", "contact") & ~c("has_identity_type"), e(_seen("schemaTypes", text("schema_types")), _seen("coverage", kinds)), True),
        Rule("BREADCRUMB_SCHEMA_MISSING", data, "low", "medium", ~home & (F.size("breadcrumbs") > 0) & ~bread, e(_seen("breadcrumbIndicators", text("breadcrumbs")), _seen("schemaTypes", text("schema_types"))), True),
        Rule("INTERNAL_LINKS_MISSING", links, "high", "medium", c("internal_link_count") == 0, e(_seen("internalLinkCount", c("internal_link_count"), "a[href]"))),
        Rule("INTERNAL_LINKS_LOW", links, "low", "low", c("internal_link_count").between(1, 2), e(_seen("internalLinkCount", c("internal_link_count"), "a[href]")), True),
        Rule("IMAGE_ALT_MISSING", links, "medium", "low", c("images_missing_alt") > 0, each("images", no_alt, lambda x: _seen("imageAltIssues", alt_issue(x), None, x["url"]))),
        Rule("EMPTY_ANCHOR_TEXT", links, "medium", "low", c("empty_anchor_count") > 0, each("links", lambda x: x["text"] == "", lambda x: _seen("links", F.to_json(x), None, x["url"]))),
        Rule("DIRECT_ANSWER_MISSING", answers, "medium", "medium", (c("question_count") > 0) & (c("direct_answer_count") == 0), e(_seen("detectedQuestions", text("detected_questions")), _seen("directAnswerCount", c("direct_answer_count"))), True),
        Rule("ENTITY_COVERAGE_MISSING", covers, "medium", "medium", some("service", "location", "contact") & ~some("entity"), dimension("entity"), True),
        Rule("SERVICE_COVERAGE_MISSING", covers, "medium", "medium", home & (c("word_count") >= 100) & some("entity", "contact") & ~some("service"), dimension("service"), True),
        Rule("LOCATION_COVERAGE_MISSING", covers, "medium", "medium", local & ~some("location"), dimension("location"), True),
        Rule("CONTACT_SIGNALS_MISSING", covers, "medium", "medium", local & ~some("contact"), dimension("contact"), True),
    ]


def findings(analyses: DataFrame, key: str = "page_id", given: list[Rule] | None = None) -> DataFrame:
    """One row for each rule that holds on each page, with its evidence, of which the first piece is also ``field`` and
    ``observed_value``; a single scan, whatever the number of rules."""
    made = [
        F.when(r.when, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit("1.0.0").alias("rule_version"), F.lit(r.category).alias("category"), F.lit(r.priority).alias("priority"), F.lit(r.effort).alias("effort"),
               F.lit("editorial-heuristic" if r.heuristic else "observation").alias("classification"), F.lit("medium" if r.heuristic else "high").alias("confidence"), r.evidence.alias("evidence")))
        for r in (given or rules())
    ]
    found = analyses.select(key, "url", F.explode(F.array_compact(F.array(*made))).alias("f")).select(key, "url", "f.*")
    first = F.get("evidence", 0)
    return found.select(*[c for c in found.columns if c != "evidence"], first["field"].alias("field"), first["observed_value"].alias("observed_value"), "evidence")


def finding_ids(analyses: DataFrame, key: str = "page_id") -> DataFrame:
    """``findings`` without evidence: the ids of the rules that hold, for counts."""
    return analyses.select(key, F.explode(F.array_compact(F.array(*[F.when(r.when, F.lit(r.rule_id)) for r in rules()]))).alias("rule_id"))


def rollup(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Distinct pages by rule."""
    return found.groupBy("rule_id").agg(F.count_distinct(key).alias("pages"))


class Lexical(NamedTuple):
    """An analyzer that looks for words; ``needs`` are lower-case strings one of which every match holds."""

    group: str
    analyzer_id: str
    label: str
    pattern: str
    review: bool
    needs: tuple[str, ...]


_ANSWER, _TRUST, _SUPPORT = "content-answerability", "trust-ymyl", "retrieval-support"
_DOT = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
# Groups, ids, labels and words of the lexical analyzers, and whether an absence asks for review.
LEXICAL = (
    Lexical(_ANSWER, "CONTENT_PRICING", "Pricing", T.words("price|pricing|cost|fees?"), False, ("pric", "cost", "fee")),
    Lexical(_ANSWER, "CONTENT_INSURANCE", "Insurance", T.words("insurance|coverage|benefits"), False, ("insurance", "coverage", "benefits")),
    Lexical(_ANSWER, "CONTENT_PROCESS", "Process", T.words("how it works|process|what to expect|steps?"), False, ("how it works", "process", "what to expect", "step")),
    Lexical(_ANSWER, "CONTENT_RISKS", "Risks and limitations", T.words("risks?|side effects?|limitations?|complications?"), True, ("risk", "side effect", "limitation", "complication")),
    Lexical(_ANSWER, "CONTENT_ALTERNATIVES", "Alternatives", T.words("alternatives?|other options?|instead of"), True, ("alternative", "other option", "instead of")),
    Lexical(_ANSWER, "CONTENT_ELIGIBILITY", "Eligibility", T.words("eligible|eligibility|candidate|who (?:is|are) (?:this|treatment) for"), True, ("eligib", "candidate", "who ")),
    Lexical(_ANSWER, "CONTENT_REVIEW_DATE", "Freshness or review date", f"(?i)(?<!\\w)(?:updated|reviewed|last modified|published)[{T.SPACES}]*(?:on)?[{T.SPACES}]*[:\\-]?[{T.SPACES}]*[A-Z0-9]", False, ("updated", "reviewed", "last modified", "published")),
    Lexical("entities", "ENTITY_PROVIDER", "Provider or author", f"(?i)(?<!\\w)(?:Dr\\.?|doctor|provider|author|reviewed by|written by){_DOT}", True, ("dr", "doctor", "provider", "author", "reviewed by", "written by")),
    Lexical(_TRUST, "TRUST_CREDENTIALS", "Credentials language", T.words("credential|certified|board-certified|licensed|fellowship|residency"), True, ("credential", "certified", "licensed", "fellowship", "residency")),
    Lexical(_TRUST, "TRUST_MEDICAL_REVIEW", "Medical review", T.words("medically reviewed|clinical review|reviewed by"), True, ("medically reviewed", "clinical review", "reviewed by")),
    Lexical(_TRUST, "TRUST_CITATIONS", "References or citations", T.words("references?|sources?|citations?|according to"), True, ("reference", "source", "citation", "according to")),
    Lexical(_TRUST, "TRUST_POLICIES", "Policies", T.words("privacy policy|terms of use|accessibility|editorial policy"), False, ("privacy policy", "terms of use", "accessibility", "editorial policy")),
    Lexical(_TRUST, "TRUST_TESTIMONIALS", "Testimonials or cases", T.words("testimonial|patient stor(?:y|ies)|case stud(?:y|ies)|before and after"), True, ("testimonial", "patient stor", "case stud", "before and after")),
    Lexical(_TRUST, "TRUST_ASSOCIATIONS", "Associations or publications", T.words("association|academy|society|publication|published|faculty|teach(?:es|ing)"), True, ("association", "academy", "society", "publication", "published", "faculty", "teach")),
    Lexical(_TRUST, "TRUST_FINANCING", "Financing", T.words("financing|payment plan|monthly payments?"), True, ("financing", "payment plan", "monthly payment")),
    Lexical(_SUPPORT, "RETRIEVAL_DEFINITIONS", "Definitions", f"(?<!\\w)[A-Z][\\p{{L}}{T.SPACES}-]{{2,40}}[{T.SPACES}]+(?:is|means|refers to)[{T.SPACES}]+", False, ("is", "means", "refers to")),
)


def _absent(a: Lexical) -> str:
    return "needs-human-review" if a.review else "not-observed"


def _may(a: Lexical, low: Column) -> Column:
    out = F.contains(low, F.lit(a.needs[0]))
    for x in a.needs[1:]:
        out = out | F.contains(low, F.lit(x))
    return out


def lexical_statuses(text: Column) -> Column:
    """An array of (group, analyzer_id, status) over one text, for counts: no value or snippet is taken out."""
    t = F.coalesce(text, F.lit(""))
    made = lambda low: F.array(*[F.struct(F.lit(a.group).alias("group"), F.lit(a.analyzer_id).alias("analyzer_id"), F.when(_may(a, low) & t.rlike(a.pattern), "observed").otherwise(_absent(a)).alias("status")) for a in LEXICAL])
    return T.let(F.lower(t), made)


def _observation(group: str, name: str, label: str, status: Column, value: Column, field: str, selector: str | None, snippet: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(group).alias("group"), F.lit(name).alias("analyzer_id"), F.lit("1.0.0").alias("analyzer_version"), F.lit(label).alias("label"), status.alias("status"),
        value.cast("string").alias("observed_value"), F.lit(field).alias("field"), (F.lit(selector) if selector else none).alias("selector"), (none if snippet is None else snippet).alias("snippet"),
    )


def lexical_observations(text: Column) -> Column:
    """An array of observations over one text: what matched first is the observed value, with its surroundings as snippet."""
    t = F.coalesce(text, F.lit(""))

    def of(a: Lexical, low: Column) -> Column:
        def row(m: Column) -> Column:
            status = F.when(m["at"] > 0, "observed").otherwise(_absent(a))
            return _observation(a.group, a.analyzer_id, a.label, status, m["hit"], "visibleText", "body", F.when(m["at"] > 0, T.around(t, m["at"], F.length(m["hit"]), 80, 120)))

        at = F.when(_may(a, low), F.regexp_instr(t, F.lit(a.pattern))).otherwise(F.lit(0))
        return T.let(T.let(at, lambda at: F.struct(at.alias("at"), F.when(at > 0, F.regexp_substr(t, F.lit(a.pattern))).alias("hit"))), row)

    return T.let(F.lower(t), lambda low: F.array(*[of(a, low) for a in LEXICAL]))


def _fixed() -> list[Column]:
    c = F.col
    seen = lambda ok, other: F.when(ok, "observed").otherwise(other)
    pair = lambda **xs: F.to_json(F.struct(*[v.alias(k) for k, v in xs.items()]))
    o, part, joined = _observation, "partially-observed", lambda name: F.to_json(c(name))
    types, errors, headings = F.size("schema_types") > 0, c("jsonld_error_count") > 0, "h1,h2,h3,h4,h5,h6"
    return [
        o("technical", "TECH_HTTP_STATUS", "HTTP retrieval", seen(c("status_code").between(200, 299), part), c("status_code"), "statusCode", None),
        o("technical", "TECH_INDEXABILITY", "Indexability directives", seen(c("is_indexable"), part), c("indexability"), "indexability", 'meta[name="robots"]'),
        o("technical", "TECH_CANONICAL", "Canonical relationship", seen(c("canonical_status") == "match", part), c("canonical_status"), "canonicalStatus", 'link[rel="canonical"]'),
        o("technical", "TECH_HEADING_STRUCTURE", "Heading structure", seen((c("h1_count") == 1) & (F.size("level_jumps") == 0), part), pair(h1Count=c("h1_count"), jumps=F.size("level_jumps")), "headingHierarchy", headings),
        o("technical", "TECH_IMAGE_ALT", "Image alternative text", F.when(c("image_count") == 0, "not-applicable").when(c("images_missing_alt") == 0, "observed").otherwise(part), pair(images=c("image_count"), missingAlt=c("images_missing_alt")), "imageAltIssues", "img"),
        o("technical", "TECH_STRUCTURED_DATA", "Structured data", F.when(types & ~errors, "observed").when(types, part).otherwise("not-observed"), pair(schemaTypes=c("schema_types"), parseErrors=c("jsonld_error_count")), "schemaTypes", 'script[type="application/ld+json"]'),
        o(_ANSWER, "CONTENT_QUESTIONS", "Visible questions", seen(c("question_count") > 0, "not-observed"), c("question_count"), "detectedQuestions", "body"),
        o(_ANSWER, "CONTENT_DIRECT_ANSWERS", "Answer proximity", F.when(c("question_count") == 0, "not-applicable").otherwise(seen(c("direct_answer_count") > 0, "not-observed")), c("direct_answer_count"), "directAnswers", "body"),
        o("entities", "ENTITY_ORGANIZATION", "Organization or brand", seen(c("entity_count") > 0, "not-observed"), joined("entity_terms"), "coverage.entity", "body"),
        o("entities", "ENTITY_SERVICE", "Services", seen(c("service_count") > 0, "not-observed"), joined("service_terms"), "coverage.service", "body"),
        o("entities", "ENTITY_LOCATION", "Locations", seen(c("location_count") > 0, "not-observed"), joined("location_terms"), "coverage.location", "body"),
        o("entities", "ENTITY_CONTACT", "Contact identity", seen(c("contact_count") > 0, "not-observed"), c("contact_count"), "coverage.contact", "body"),
        o("entities", "ENTITY_SCHEMA_VISIBLE_CONSISTENCY", "Schema-to-visible consistency", F.when(types & (c("entity_count") > 0), part).otherwise("needs-human-review"), pair(schemaTypes=c("schema_types"), entityTerms=c("entity_terms")), "coverage", "body"),
        o(_SUPPORT, "RETRIEVAL_EXTRACTABLE_ANSWERS", "Extractable answers", F.when(c("direct_answer_count") > 0, "observed").when(c("question_count") > 0, part).otherwise("not-observed"), pair(questions=c("question_count"), directAnswers=c("direct_answer_count")), "directAnswers", "body"),
        o(_SUPPORT, "RETRIEVAL_SECTION_CLARITY", "Section clarity", seen(c("heading_count") > 1, part), pair(headings=c("heading_count"), jumps=F.size("level_jumps")), "headingHierarchy", headings),
        o(_SUPPORT, "RETRIEVAL_ENTITY_NAMING", "Entity naming", seen(c("entity_count") > 0, "not-observed"), joined("entity_terms"), "coverage.entity", "body"),
        o(_SUPPORT, "RETRIEVAL_EVIDENCE_DENSITY", "Evidence density", F.when(c("word_count") > 0, part).otherwise("not-observed"), pair(words=c("word_count"), headings=c("heading_count"), directAnswers=c("direct_answer_count"), externalDomains=F.size("external_domains")), "contentCounts", "body"),
    ]


def observations(analyses: DataFrame, key: str = "page_id") -> DataFrame:
    """The 33 analyzer observations of each page: status, label, observed value and where it was seen."""
    every = F.concat(F.array(*_fixed()), lexical_observations(F.col("visible_text")))
    return analyses.select(key, F.explode(every).alias("o")).select(key, "o.*")


def observation_counts(analyses: DataFrame) -> DataFrame:
    """Pages by group, analyzer and status."""
    short = [F.struct(*[x[n].alias(n) for n in ("group", "analyzer_id", "status")]) for x in _fixed()]
    every = F.concat(F.array(*short), lexical_statuses(F.col("visible_text")))
    return analyses.select(F.inline(every)).groupBy("group", "analyzer_id", "status").agg(F.count("*").alias("pages"))
