"""Threshold opportunities over accepted facts, their identity, first-wins dedupe, and status-keeping merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T

STATES = ("new", "reviewing", "accepted", "in-progress", "implemented", "verified", "dismissed")


def row_rules() -> list[tuple[str, str, str, Column]]:
    """(rule, metric type, priority, predicate) of rules that look at one row."""
    c = F.col
    rate = c("conversions") / c("sessions")
    return [
        ("SEARCH_HIGH_IMPRESSIONS_LOW_CTR", "search-performance", "high", (c("impressions") >= 100) & (c("ctr") < 0.03)),
        ("SEARCH_STRONG_POSITION_LOW_CTR", "search-performance", "high", (c("impressions") >= 50) & (c("average_position") <= 5) & (c("ctr") < 0.03)),
        ("SEARCH_PAGE_TWO_DEMAND", "search-performance", "medium", (c("impressions") >= 50) & (c("average_position") > 10) & (c("average_position") <= 20)),
        ("ENGAGEMENT_HIGH_TRAFFIC_WEAK_ENGAGEMENT", "web-analytics", "high", (c("sessions") >= 100) & (c("engagement_rate") < 0.4)),
        ("ENGAGEMENT_HIGH_TRAFFIC_LOW_CONVERSION", "web-analytics", "high", (c("sessions") >= 100) & (rate < 0.01)),
        ("ENGAGEMENT_LOW_TRAFFIC_STRONG_CONVERSION", "web-analytics", "medium", (c("sessions") > 0) & (c("sessions") < 50) & (rate >= 0.05)),
        ("CAMPAIGN_SPEND_WITHOUT_CONVERSION", "campaign-performance", "high", (c("spend") >= 100) & (c("conversions") == 0)),
        ("LEAD_VOLUME_LOW_QUALIFICATION", "lead-summary", "high", (c("leads") >= 20) & (c("qualified_leads") / c("leads") < 0.25)),
    ]


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def multi_page(metrics: DataFrame, least_impressions: int = 100) -> DataFrame:
    """Queries that several pages share on equal dates, device and country: pages, summed impressions, the sum as text."""
    g = ["project_id", "query_key", "date", "date_to", "device_key", "country_key"]
    rows = metrics.where("metric_type = 'search-performance'").withColumns({"query_key": F.lower("query"), "device_key": F.lower("device"), "country_key": F.lower("country")})
    terms = F.transform(F.array_sort(F.collect_list(F.struct("row_number", "impressions"))), lambda x: x["impressions"].cast("string"))
    out = rows.groupBy(*g).agg(F.count_distinct("page").alias("pages"), F.sum("impressions").alias("impressions"), F.array_join(terms, " + ").alias("expression"), F.min("row_number").alias("row_number"), F.array_sort(F.collect_list("metric_id")).alias("metric_ids"))
    return out.where((F.col("pages") > 1) & (F.col("impressions") >= least_impressions))


def opportunity_id(project: Column, rule: Column, group_key: Column) -> Column:
    return F.concat(F.lit("opportunity:"), F.substring(T.sha(project, rule, group_key), 1, 32))


def opportunities(accepted: DataFrame) -> DataFrame:
    """``opportunity_id, project_id, rule_id, priority, page, query, group_key, row_number, metric_ids`` of one import's rows.

    The first row of an id wins, and only its evidence is kept.
    """
    m = _with(accepted, page="string", query="string", impressions="long", ctr="double", average_position="double", sessions="long", engagement_rate="double", conversions="double", spend="double", leads="long", qualified_leads="long", device="string", country="string")
    made = [F.when((F.col("metric_type") == kind) & F.coalesce(when, F.lit(False)), F.struct(F.lit(i).alias("at"), F.lit(rule).alias("rule_id"), F.lit(priority).alias("priority"))) for i, (rule, kind, priority, when) in enumerate(row_rules())]
    key = F.concat(F.coalesce("page", F.lit("all-pages")), F.lit("‖"), F.coalesce("query", F.lit("all-queries")))
    single = m.select("project_id", "page", "query", key.alias("group_key"), "row_number", F.array("metric_id").alias("metric_ids"), F.explode(F.array_compact(F.array(*made))).alias("r"))
    single = single.select("project_id", "page", "query", "group_key", "row_number", "metric_ids", "r.*")
    many = multi_page(m).select(
        "project_id", F.lit(None).cast("string").alias("page"), F.col("query_key").alias("query"), F.concat_ws("‖", "query_key", "date", F.coalesce(F.col("date_to").cast("string"), F.lit("")), "device_key", "country_key").alias("group_key"),
        "row_number", "metric_ids", F.lit(99).alias("at"), F.lit("SEARCH_QUERY_MULTIPLE_PAGES").alias("rule_id"), F.lit("medium").alias("priority"),
    )
    every = single.unionByName(many).withColumn("opportunity_id", opportunity_id(F.col("project_id"), F.col("rule_id"), F.col("group_key")))
    w = Window.partitionBy("opportunity_id").orderBy("row_number", "at")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "at")


def merge(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Upsert by id: a stored opportunity keeps its status and creation time, a fresh one starts as new."""
    old = stored.select("opportunity_id", F.col("status").alias("_s"), F.col("created_at").alias("_c"))
    updated = fresh.join(old, "opportunity_id", "left").withColumn("status", F.coalesce("_s", F.lit("new"))).withColumn("created_at", F.coalesce("_c", now)).withColumn("updated_at", now).drop("_s", "_c")
    rest = stored.join(fresh.select("opportunity_id"), "opportunity_id", "left_anti")
    return updated.unionByName(rest, allowMissingColumns=True)


def set_status(stored: DataFrame, opportunity: str, state: str, now: Column) -> DataFrame:
    if state not in STATES:
        raise ValueError(f"unknown status {state}")
    hit = F.col("opportunity_id") == opportunity
    return stored.withColumn("status", F.when(hit, F.lit(state)).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def term_overlap(queries: DataFrame, texts: DataFrame, query_id: str, query: str, text_id: str, text: str) -> DataFrame:
    """Pairs that share a term of three characters or more, with the number shared; an equi-join on exploded terms."""
    a = queries.select(query_id, F.explode(T.terms(F.col(query))).alias("term"))
    b = texts.select(text_id, F.explode(T.terms(F.col(text))).alias("term"))
    return a.join(b, "term").groupBy(query_id, text_id).agg(F.count("*").alias("shared"))
