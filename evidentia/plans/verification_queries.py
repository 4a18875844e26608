"""Queries over ``events`` and the relational tables: verification of runs, report inventories, cards and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import compare, history, linkage, reports
from evidentia.plans import run_queries


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _run_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sites of runs of 4; some aren't usable, some are degraded."""
    key = F.col("user_id")
    made = _events(spark, sf_dir).groupBy(key.alias("site_key")).agg(F.min("event_id").alias("e"))
    state = F.when(F.col("e") % 5 == 0, "ineligible").when(F.col("e") % 3 == 0, "degraded").otherwise("eligible")
    return made.select("site_key", F.expr("site_key div 4").alias("run_id"), (F.col("site_key") % 4).alias("input_order"), (F.col("e") % 5 != 0).alias("usable"), state.alias("eligibility"), F.when(F.col("site_key") % 4 == 0, "target").otherwise("competitor").alias("role"))


def comparison_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status(_run_sites(spark, sf_dir))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "site_key")
    return history.page_summary(_run_sites(spark, sf_dir), e.where("event_type = 'click'"), e.where("value > 50"))


def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.inventory(_events(spark, sf_dir).withColumnRenamed("user_id", "site_key").where("value > 80"), _run_sites(spark, sf_dir))


def artifact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as artifacts of a rule by size; gaps are the sizes of some parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    artifacts = p.groupBy(F.col("p_partkey").alias("artifact_id")).agg(F.max("p_size").alias("rule_id"))
    gaps = p.where("p_partkey % 3 = 0").select(F.col("p_size").alias("rule_id")).where("rule_id % 2 = 0")
    before = p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("artifact_id"))
    return history.proposal_links(artifacts, gaps, before, F.col("artifact_id") % 7 != 0)


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.verification_counts(_run_sites(spark, sf_dir), history.evidence_changes(run_queries.run_diff(spark, sf_dir)), artifact_links(spark, sf_dir))


def visibility_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of one target, asked for by a URL that isn't normalized, newest first."""
    e = _events(spark, sf_dir)
    seen = e.select(F.col("event_id").alias("observation_id"), F.concat(F.lit("https://t.example/"), F.col("user_id") % 20).alias("target_url"), F.col("ts").alias("created_at"))
    listed = linkage.visibility_list(seen, " HTTPS://T.example:443/7#a")
    return listed.select("observation_id", "target_url")


def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as projects, orders as runs of a customer's nation, lines as their metrics."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    target = F.concat(F.lit("https://n.example/"), F.col("c_nationkey"))
    runs = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("run_id"), target.alias("target_url"), F.col("o_orderdate").alias("created_at"))
    projects = read("nation").select(F.col("n_nationkey").alias("project_id"), F.concat(F.lit("https://n.example/"), F.col("n_nationkey")).alias("target_url"))
    lines = read("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("metric_id"), F.col("l_partkey").alias("number"))
    return linkage.latest_run_metrics(projects, runs, lines)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select((F.col("user_id") % 3).cast("string").alias("project_id"), (F.col("event_id") % 11).alias("import_id"), (F.col("event_id") % 5).alias("clicks"), F.floor("value").cast("long").alias("impressions"))


def metric_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one project."""
    return reports.metric_cards(reports.chosen(_metrics(spark, sf_dir), project_id="1", import_id=None))


def opportunity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = o.select(F.when(F.col("o_orderkey") % 3 == 0, "high").otherwise("low").alias("priority"), F.when(F.col("o_orderstatus") == "O", "new").otherwise("done").alias("status"), (F.col("o_custkey") % 4).cast("string").alias("category"))
    return reports.opportunity_cards(reports.chosen(made, category="2", status="all"))


QUERIES = {f.__name__: f for f in (comparison_status, page_summary, report_inventory, artifact_links, verification_summary, visibility_list, project_metrics, metric_cards, opportunity_cards)}

_SITES = """s AS (SELECT user_id AS site_key, user_id // 4 AS run_id, user_id % 4 AS input_order, min(event_id) % 5 <> 0 AS usable,
 CASE WHEN min(event_id) % 5 = 0 THEN 'ineligible' WHEN min(event_id) % 3 = 0 THEN 'degraded' ELSE 'eligible' END AS eligibility FROM events GROUP BY user_id)"""
_LINKS = """g AS (SELECT DISTINCT p_size AS rule_id FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 0),
l AS (SELECT p_partkey AS artifact_id, max(p_size) AS rule_id FROM part GROUP BY 1),
links AS (SELECT artifact_id, rule_id, CASE WHEN artifact_id % 7 = 0 THEN 'indeterminate' WHEN rule_id NOT IN (SELECT rule_id FROM g) THEN 'resolved' WHEN artifact_id % 5 = 0 THEN 'regressed' ELSE 'unchanged' END AS change FROM l)"""
ORACLE_SQL = {
    "comparison_status": f"WITH {_SITES} SELECT run_id, CASE WHEN NOT coalesce(bool_or(input_order = 0 AND usable), false) OR NOT coalesce(bool_or(input_order > 0 AND usable), false) THEN 'unavailable' WHEN bool_and(eligibility = 'eligible') THEN 'complete' ELSE 'partial' END AS status FROM s GROUP BY 1",
    "page_summary": f"WITH {_SITES} SELECT site_key, CASE WHEN input_order = 0 THEN 'target' ELSE 'competitor' END AS role, input_order, eligibility, (SELECT count(*) FROM events e WHERE e.user_id = site_key AND event_type = 'click') AS finding_count, (SELECT count(*) FROM events e WHERE e.user_id = site_key AND value > 50) AS observation_count FROM s",
    "report_inventory": f"WITH {_SITES} SELECT site_key, input_order, (SELECT count(*) FROM events e WHERE e.user_id = site_key AND value > 80) AS findings FROM s",
    "artifact_links": f"WITH {_LINKS} SELECT * FROM links",
    "verification_summary": f"WITH {_LINKS}, d AS ({run_queries.ORACLE_SQL['run_diff']}) SELECT (SELECT count(DISTINCT user_id) FROM events) AS compared_pages, (SELECT count(*) + count(*) FILTER (scope = 'competitor') FROM d) AS changed_evidence_records, (SELECT count(*) FROM links WHERE change = 'resolved') AS resolved_artifacts",
    "visibility_list": "SELECT event_id AS observation_id, 'https://t.example/7' AS target_url FROM events WHERE user_id % 20 = 7 ORDER BY ts DESC, event_id",
    "project_metrics": """WITH r AS (SELECT c_nationkey AS project_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT project_id, run_id, l_linenumber AS metric_id, l_partkey AS number FROM r JOIN lineitem ON l_orderkey = run_id WHERE project_id IN (SELECT n_nationkey FROM nation)""",
    "metric_cards": "SELECT count(*) AS records, count(DISTINCT user_id % 3) AS projects, count(DISTINCT event_id % 11) AS imports, coalesce(sum(event_id % 5), 0)::BIGINT AS clicks, coalesce(sum(floor(value)), 0)::BIGINT AS impressions FROM events WHERE user_id % 3 = 1",
    "opportunity_cards": """SELECT count(*) AS opportunities, count(*) FILTER (o_orderkey % 3 = 0) AS high, count(*) FILTER (o_orderstatus = 'O') AS "new" FROM orders WHERE o_custkey % 4 = 2""",
}
