"""Queries over ``events`` as aggregate facts: normalization, dedupe, filters, opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import facts, opportunities

SEARCH = {"query": "Query", "page": "Page", "date": "Date", "clicks": "Clicks", "impressions": "Impressions", "ctr": "CTR", "averagePosition": "Position", "device": "Device"}
WEB = {"page": "Page", "date": "Date", "sessions": "Sessions", "engagementRate": "Engagement", "conversions": "Conversions"}


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search export, as text: some rows break a rule."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, v = F.col("event_id"), F.floor("value").cast("long")
    clicks = n % 5
    impressions = v + 20
    return e.select(
        (n + 1).alias("row_number"), F.when(n % 97 == 0, F.lit("=SUM(A1)")).otherwise(F.concat(F.lit("q"), F.col("user_id") % 20)).alias("Query"), F.concat(F.lit("/p"), F.col("user_id") % 7).alias("Page"),
        F.when(n % 89 == 0, F.lit("2024-02-30")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date"), F.when(n % 83 == 0, F.lit("")).otherwise(clicks.cast("string")).alias("Clicks"), impressions.cast("string").alias("Impressions"),
        F.concat(F.floor(100 * clicks / impressions).cast("string"), F.lit("%")).alias("CTR"), ((n % 25)).cast("string").alias("Position"), F.col("event_type").alias("Device"),
    )


def web_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    return e.select(
        (n + 1).alias("row_number"), F.concat(F.lit("/p"), F.col("user_id") % 7, F.lit("/"), n).alias("Page"), F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.floor("value").cast("string").alias("Sessions"), F.concat((n % 100).cast("string"), F.lit("%")).alias("Engagement"), (n % 4).cast("string").alias("Conversions"),
    )


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.normalize(search_rows(spark, sf_dir), "search-console-csv", SEARCH, "project", "export", "import-1")


def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _search(spark, sf_dir)
    good = F.col("error_code").isNull()
    kept = lambda c: F.when(good, F.col(c)).alias(c)
    return out.select("row_number", kept("query"), kept("page"), F.when(good, F.col("date").cast("string")).alias("date"), kept("clicks"), kept("impressions"), "error_code", "error_field")


def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.counters(facts.judge(_search(spark, sf_dir))).select("accepted", "rejected", "duplicates", F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"))


def reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file again: nothing is accepted."""
    first, _ = facts.split_duplicates(_search(spark, sf_dir))
    return facts.counters(facts.judge(_search(spark, sf_dir), first)).select("accepted", "rejected")


def metric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = facts.split_duplicates(_search(spark, sf_dir))
    got = facts.filter_metrics(m, "search-performance", page="P3", query="Q1", device="VIEW", date_from="2024-01-05", date_to="2024-01-20")
    return got.select("row_number", "query", "page", F.col("date").cast("string").alias("date"), "clicks")


def opportunity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    search, _ = facts.split_duplicates(_search(spark, sf_dir))
    web, _ = facts.split_duplicates(facts.normalize(web_rows(spark, sf_dir), "web-analytics-csv", WEB, "project", "web", "import-2"))
    found = opportunities.opportunities(search).unionByName(opportunities.opportunities(web))
    return found.where("rule_id <> 'SEARCH_QUERY_MULTIPLE_PAGES'").select("rule_id", "page", "query", "row_number", "priority")


def multi_page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = facts.split_duplicates(_search(spark, sf_dir))
    return opportunities.multi_page(m).select(F.col("query_key").alias("query"), F.col("date").cast("string").alias("date"), F.col("device_key").alias("device"), "pages", "impressions", "expression")


QUERIES = {f.__name__: f for f in (search_facts, import_counters, reimport, metric_filter, opportunity_rules, multi_page_queries)}

_ROWS = """raw AS (SELECT event_id AS n, event_id + 1 AS row_number, 'q' || (user_id % 20) AS query, '/p' || (user_id % 7) AS page, strftime(ts, '%Y-%m-%d') AS date, event_id % 5 AS clicks, floor(value)::BIGINT + 20 AS impressions,
 (event_id % 25)::DOUBLE AS position, event_type AS device FROM events),
rates AS (SELECT *, floor(100 * clicks / impressions) AS pct FROM raw),
checked AS (SELECT *, CASE WHEN pct > 1 OR true THEN pct / 100 END AS ctr,
 CASE WHEN n % 97 = 0 THEN 'FORMULA_VALUE/query' WHEN n % 89 = 0 THEN 'INVALID_VALUE/date' WHEN n % 83 = 0 THEN 'MISSING_VALUE/clicks' WHEN clicks > impressions THEN 'INVALID_VALUE/clicks'
 WHEN abs(clicks / impressions - pct / 100) > 0.005 THEN 'INVALID_VALUE/ctr' WHEN position <= 0 THEN 'INVALID_VALUE/averagePosition' END AS bad FROM rates),
good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, page, date, clicks, impressions, ctr, position, device ORDER BY row_number) AS k FROM checked WHERE bad IS NULL) WHERE k = 1)"""
_RULES = """found AS (SELECT row_number, query, page, unnest([CASE WHEN impressions >= 100 AND ctr < 0.03 THEN 'SEARCH_HIGH_IMPRESSIONS_LOW_CTR' END, CASE WHEN impressions >= 50 AND position <= 5 AND ctr < 0.03 THEN 'SEARCH_STRONG_POSITION_LOW_CTR' END,
 CASE WHEN impressions >= 50 AND position > 10 AND position <= 20 THEN 'SEARCH_PAGE_TWO_DEMAND' END]) AS rule_id FROM good
 UNION ALL SELECT event_id + 1, NULL, '/p' || (user_id % 7) || '/' || event_id, unnest([CASE WHEN floor(value) >= 100 AND (event_id % 100) / 100 < 0.4 THEN 'ENGAGEMENT_HIGH_TRAFFIC_WEAK_ENGAGEMENT' END,
 CASE WHEN floor(value) >= 100 AND (event_id % 4) / floor(value) < 0.01 THEN 'ENGAGEMENT_HIGH_TRAFFIC_LOW_CONVERSION' END, CASE WHEN floor(value) > 0 AND floor(value) < 50 AND (event_id % 4) / floor(value) >= 0.05 THEN 'ENGAGEMENT_LOW_TRAFFIC_STRONG_CONVERSION' END]) FROM events)"""
ORACLE_SQL = {
    "search_facts": f"WITH {_ROWS} SELECT row_number, CASE WHEN bad IS NULL THEN query END AS query, CASE WHEN bad IS NULL THEN page END AS page, CASE WHEN bad IS NULL THEN date END AS date, CASE WHEN bad IS NULL THEN clicks END AS clicks, CASE WHEN bad IS NULL THEN impressions END AS impressions, nullif(split_part(bad, '/', 1), '') AS error_code, nullif(split_part(bad, '/', 2), '') AS error_field FROM checked",
    "import_counters": f"WITH {_ROWS} SELECT (SELECT count(*) FROM good) AS accepted, (SELECT count(*) FROM checked) - (SELECT count(*) FROM good) AS rejected, (SELECT count(*) FROM checked WHERE bad IS NULL) - (SELECT count(*) FROM good) AS duplicates, (SELECT min(date) FROM good) AS date_from, (SELECT max(date) FROM good) AS date_to",
    "reimport": "SELECT 0::BIGINT AS accepted, count(*) AS rejected FROM events",
    "metric_filter": f"WITH {_ROWS} SELECT row_number, query, page, date, clicks FROM good WHERE contains(page, 'p3') AND contains(query, 'q1') AND device = 'view' AND date BETWEEN '2024-01-05' AND '2024-01-20'",
    "opportunity_rules": f"WITH {_ROWS}, {_RULES} SELECT rule_id, page, query, row_number, CASE WHEN rule_id IN ('SEARCH_PAGE_TWO_DEMAND', 'ENGAGEMENT_LOW_TRAFFIC_STRONG_CONVERSION') THEN 'medium' ELSE 'high' END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, page, query ORDER BY row_number) AS k FROM found WHERE rule_id IS NOT NULL) WHERE k = 1",
    "multi_page_queries": f"WITH {_ROWS} SELECT query, date, device, count(DISTINCT page) AS pages, sum(impressions)::BIGINT AS impressions, string_agg(impressions, ' + ' ORDER BY row_number) AS expression FROM good GROUP BY query, date, device HAVING count(DISTINCT page) > 1 AND sum(impressions) >= 100",
}
