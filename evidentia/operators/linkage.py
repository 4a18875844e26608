"""Links between facts, pages, ranks and sources: rank lookup, matching page evidence, the detail of a search metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U
from evidentia.operators.history import latest

# Public references and the analyzers they bear on.
SOURCES = (
    ("RFC-9309", "internet-standard", "https://www.rfc-editor.org/rfc/rfc9309", ("TECH_INDEXABILITY",)),
    ("GOOGLE-ROBOTS-META", "official-guidance", "https://developers.google.com/search/docs/crawling-indexing/robots-meta-tag", ("TECH_INDEXABILITY",)),
    ("GOOGLE-STRUCTURED-DATA", "official-guidance", "https://developers.google.com/search/docs/appearance/structured-data/intro-structured-data", ("TECH_STRUCTURED_DATA", "ENTITY_SCHEMA_VISIBLE_CONSISTENCY")),
    ("SCHEMA-ORG-ORGANIZATION", "schema-vocabulary", "https://schema.org/Organization", ("ENTITY_ORGANIZATION", "ENTITY_LOCATION", "ENTITY_CONTACT", "ENTITY_PROVIDER", "ENTITY_SCHEMA_VISIBLE_CONSISTENCY")),
    ("SCHEMA-ORG-FAQPAGE", "schema-vocabulary", "https://schema.org/FAQPage", ("CONTENT_QUESTIONS", "CONTENT_DIRECT_ANSWERS", "RETRIEVAL_EXTRACTABLE_ANSWERS")),
    ("WCAG-22-NON-TEXT", "accessibility-guidance", "https://www.w3.org/WAI/WCAG22/Understanding/non-text-content.html", ("TECH_IMAGE_ALT",)),
)


def research_sources(spark: SparkSession) -> DataFrame:
    """``source_id, source_type, url, analyzer_id``: a small literal table to join observations with."""
    rows = [(i, kind, url, a) for i, kind, url, analyzers in SOURCES for a in analyzers]
    return spark.createDataFrame(rows, "source_id string, source_type string, url string, analyzer_id string")


def with_rank(sites: DataFrame, ranks: DataFrame, candidates: list[str]) -> DataFrame:
    """``sites`` with ``rank``: the position of its first candidate URL that matches, exactly before canonically.

    ``ranks`` has ``run_id, url, position`` (1 to 1000). Every candidate is one equi-join row; no OR-join.
    """
    places = [F.struct(F.lit(2 * i + k).alias("at"), (F.col(c) if not k else U.canonical(F.col(c))).alias("key"), F.lit(bool(k)).alias("canonical")) for i, c in enumerate(candidates) for k in (0, 1)]
    keyed = sites.select("run_id", "input_order", F.inline(F.array(*places)))
    valid = ranks.where(F.col("position").between(1, 1000))
    known = valid.select("run_id", F.col("url").alias("key"), F.lit(False).alias("canonical"), "position").unionByName(valid.select("run_id", U.canonical(F.col("url")).alias("key"), F.lit(True).alias("canonical"), "position"))
    best = keyed.join(known, ["run_id", "key", "canonical"]).groupBy("run_id", "input_order").agg(F.min_by("position", F.struct("at", "position")).alias("rank"))
    return sites.join(best, ["run_id", "input_order"], "left")


def page_evidence(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """The first analysed page (by ``input_order``) whose final or normalized URL is the metric's page."""
    keys = pages.select("input_order", "final_url", "title", F.explode(F.array_distinct(F.array(U.canonical(F.col("final_url")), U.canonical(F.col("normalized_url"))))).alias("page_key"))
    hits = metrics.withColumn("page_key", U.canonical(F.col("page"))).join(keys, "page_key")
    w = Window.partitionBy("metric_id").orderBy("input_order")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("metric_id", "final_url", "title")


def metric_opportunity(metrics: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``metric_id, opportunity_id``: the first opportunity (by ``row_number``) whose evidence has the metric."""
    e = opportunities.select("opportunity_id", "row_number", F.explode("metric_ids").alias("metric_id"))
    return metrics.select("metric_id").join(e, "metric_id").groupBy("metric_id").agg(F.min_by("opportunity_id", F.struct("row_number", "opportunity_id")).alias("opportunity_id"))


def query_related(metrics: DataFrame, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``metric_id, text_id`` pairs whose texts share a term of three characters with the metric's query."""
    a = metrics.select("metric_id", F.explode(T.terms(F.col("query"))).alias("term"))
    b = texts.select(text_id, F.explode(T.terms(F.col(text))).alias("term"))
    return a.join(b, "term").select("metric_id", text_id).distinct()


def search_detail(metrics: DataFrame, pages: DataFrame, opportunities: DataFrame, gaps: DataFrame) -> DataFrame:
    """Search metrics with matching page evidence, their opportunity and the number of related gaps."""
    related = query_related(metrics, gaps, "gap_id", "gap_text").groupBy("metric_id").agg(F.count("*").alias("related_gaps"))
    out = metrics.join(page_evidence(metrics, pages), "metric_id", "left").join(metric_opportunity(metrics, opportunities), "metric_id", "left").join(related, "metric_id", "left")
    note = F.when(F.col("final_url").isNull(), "No analysed page matches the imported page; none is inferred.").otherwise("Page evidence is from the latest saved run and may differ in time.")
    return out.withColumn("related_gaps", F.coalesce("related_gaps", F.lit(0))).withColumn("limitation", note)


def visibility_violations(observations: DataFrame) -> DataFrame:
    """Manual visibility observations without a rank (1 to 1000) and without a citation."""
    ranked = F.coalesce(F.col("rank").between(1, 1000), F.lit(False))
    cited = F.coalesce(F.col("citation_url").startswith("http"), F.lit(False))
    return observations.where(~(ranked | cited) | (F.col("rank").isNotNull() & ~ranked))


def visibility_list(observations: DataFrame, target: str | None = None) -> DataFrame:
    """Manual visibility observations, of one target (a URL, normalized before it is compared) or all; newest first, then by id."""
    if target is not None:
        observations = observations.where(F.col("target_url") == F.lit(U.normalize_py(target)))
    return observations.orderBy(F.desc("created_at"), "observation_id")


def latest_run_metrics(projects: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """``project_id, run_id`` and the metrics of the newest run of each project's target; projects without a run have none."""
    newest = latest(runs.select("run_id", "target_url", "created_at"), "target_url", "created_at", "run_id")
    chosen = projects.select("project_id", "target_url").join(newest, "target_url").select("project_id", "run_id")
    return chosen.join(metrics, "run_id").select("project_id", "run_id", *[c for c in metrics.columns if c not in ("project_id", "run_id")])
