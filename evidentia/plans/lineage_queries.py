"""Chains, histories and structural checks of runs and requests that Spark makes of the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import constraints, lineage
from evidentia.sources.scratch import settled


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def run_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 50 customers each as one chain of runs; the first of some chains follows the last one, that of others a run that isn't there."""
    g = F.floor(F.col("o_custkey") / 50)
    w = Window.partitionBy("g").orderBy("o_orderkey")
    placed = _orders(spark, sf_dir).select(g.alias("g"), "o_orderkey").withColumns({"p": F.lag("o_orderkey").over(w), "last": F.max("o_orderkey").over(Window.partitionBy("g"))})
    before = F.coalesce("p", F.when(F.col("g") % 7 == 3, F.col("last")).when(F.col("g") % 7 == 5, F.lit(-1)))
    return lineage.chains(placed.select(F.col("o_orderkey").alias("run_id"), before.alias("previous_id")))


_TRACKED = {"technical": ("status_code",), "metadata": ("title",), "content": ("word_count",)}


def _run_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs, their lines as sites; the previous run is the customer's order before."""
    runs = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("previous_id"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_returnflag").alias("flag"), F.max("l_discount").alias("d"))
    usable = F.col("flag") != "R"
    sites = lines.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("site_key"), F.when(F.col("l_linenumber") == 1, "target").otherwise("competitor").alias("role"), usable.alias("usable"), F.when(usable, "eligible").otherwise("ineligible").alias("eligibility"),
        F.array().cast("array<string>").alias("schema_types"), (F.col("q") % 4).alias("status_code"), F.col("flag").alias("title"), F.floor(F.col("q") / 10).alias("word_count"),
    )
    return runs, sites


def run_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between each run and the one before: number of changes by field."""
    runs, sites = _run_sites(spark, sf_dir)
    found = lineage.histories(sites, runs, _TRACKED)
    return found.groupBy("run_id", "previous_id", "field").agg(F.count("*").alias("changes"), F.count_if(F.col("scope") == "target").alias("of_target"))


def history_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored histories some of which were tampered with, held against those computed again: the rows that differ, nothing else is opened."""
    runs, sites = _run_sites(spark, sf_dir)
    again = settled(lineage.histories(sites, runs, _TRACKED))  # four readers
    tampered = (F.col("run_id") % 50 == 7) & (F.col("field") == "word_count")
    stored = again.withColumn("new", F.when(tampered, F.concat("new", F.lit("0"))).otherwise(F.col("new"))).where("not (run_id % 50 = 9 and field = 'title')")
    found = lineage.opened(stored, again)
    return found.groupBy("run_id", "field", "side").agg(F.count("*").alias("rows"))


def request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison requests made of orders, each field beyond its bounds somewhere."""
    o = _orders(spark, sf_dir)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = lambda n: F.concat(F.lit("https://s"), n.cast("string"), F.lit(".example/"))
    rivals = F.transform(F.sequence(F.lit(0), k % 7), lambda i: F.when((i == 3) & (c % 5 == 0), F.lit("ftp://x")).otherwise(url((k + i * (c % 3)) % 9)))
    made = o.select(
        k.alias("request_id"), F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.lit("nowhere")).otherwise(url(c % 9)).alias("target_url"), F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(rivals).alias("competitor_urls"),
        F.repeat(F.lit("x"), (c % 4 * 70).cast("int")).alias("query_label"), F.array(F.struct(url(c % 9).alias("url"), (k % 1100).alias("position"))).alias("rank_observations"),
    )
    found = constraints.compare_requests(made, "request_id")
    return found.groupBy("request_id", "path", "problem").agg(F.count("*").alias("times"))


QUERIES = {f.__name__: f for f in (run_chains, run_histories, history_audit, request_violations)}

_RUNS = """runs AS (SELECT o_orderkey AS run_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_id FROM orders),
s AS (SELECT l_orderkey AS run_id, l_linenumber AS k, max(l_quantity)::INT AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
j AS (SELECT r.run_id, r.previous_id, b.k, a.f <> 'R' AND b.f <> 'R' AS ok, a.f AS f0, b.f AS f1, a.q % 4 AS c0, b.q % 4 AS c1, a.q // 10 AS w0, b.q // 10 AS w1 FROM runs r JOIN s b ON b.run_id = r.run_id JOIN s a ON a.run_id = r.previous_id AND a.k = b.k),
x AS (SELECT run_id, previous_id, k, unnest(list_filter([CASE WHEN c0 <> c1 THEN 'status_code' END, CASE WHEN (f0 = 'R') <> (f1 = 'R') THEN 'eligibility' END, CASE WHEN ok AND f0 <> f1 THEN 'title' END, CASE WHEN ok AND w0 <> w1 THEN 'word_count' END], lambda v: v IS NOT NULL)) AS field FROM j)"""
_U = "'https://s' || {} || '.example/'"
ORACLE_SQL = {
    "run_chains": """WITH RECURSIVE p AS (SELECT o_custkey // 50 AS g, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS b, max(o_orderkey) OVER (PARTITION BY o_custkey // 50) AS z FROM orders),
n AS (SELECT k AS run_id, coalesce(b, CASE WHEN g % 7 = 3 THEN z WHEN g % 7 = 5 THEN -1 END) AS previous_id FROM p),
walk AS (SELECT run_id, run_id AS root, 0::BIGINT AS position FROM n WHERE previous_id IS NULL OR previous_id NOT IN (SELECT run_id FROM n) UNION ALL SELECT n.run_id, w.root, w.position + 1 FROM walk w JOIN n ON n.previous_id = w.run_id)
SELECT n.run_id, n.previous_id, w.root, w.position, CASE WHEN w.root IS NULL THEN 'cycle' WHEN w.position = 0 AND n.previous_id IS NOT NULL THEN 'unknown previous run' END AS problem FROM n LEFT JOIN walk w USING (run_id)""",
    "run_histories": f"WITH {_RUNS} SELECT run_id, previous_id, field, count(*) AS changes, count(*) FILTER (WHERE k = 1) AS of_target FROM x GROUP BY ALL",
    "history_audit": f"""WITH {_RUNS}, t AS (SELECT run_id, field, count(*) AS n FROM x GROUP BY ALL)
SELECT run_id, field, 'expected' AS side, n AS rows FROM t WHERE (run_id % 50 = 7 AND field = 'word_count') OR (run_id % 50 = 9 AND field = 'title') UNION ALL SELECT run_id, field, 'stored', n FROM t WHERE run_id % 50 = 7 AND field = 'word_count'""",
    "request_violations": f"""WITH m AS (SELECT o_orderkey AS request_id, o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'nowhere' ELSE {_U.format('(o_custkey % 9)')} END AS t, {_U.format('(o_custkey % 9)')} AS r,
 CASE WHEN o_orderkey % 13 = 0 THEN [] ELSE list_transform(range(0, o_orderkey % 7 + 1), lambda i: CASE WHEN i = 3 AND o_custkey % 5 = 0 THEN 'ftp://x' ELSE {_U.format('((o_orderkey + i * (o_custkey % 3)) % 9)')} END) END AS vs FROM orders),
f AS (SELECT request_id, 'target_url' AS path, 'is missing' AS problem FROM m WHERE t IS NULL UNION ALL SELECT request_id, 'target_url', 'has another form' FROM m WHERE t = 'nowhere'
 UNION ALL SELECT request_id, 'competitor_urls', 'is below 1' FROM m WHERE len(vs) = 0 UNION ALL SELECT request_id, 'competitor_urls', 'is above 5' FROM m WHERE len(vs) > 5
 UNION ALL SELECT request_id, 'competitor_urls', 'repeats a value' FROM m WHERE len(list_distinct(vs)) < len(vs) UNION ALL SELECT request_id, 'competitor_urls[3]', 'has another form' FROM m WHERE vs[4] = 'ftp://x'
 UNION ALL SELECT request_id, 'competitor_urls', 'holds the target' FROM m WHERE t IN (SELECT unnest(vs)) UNION ALL SELECT request_id, 'query_label', 'is above 200' FROM m WHERE c % 4 = 3
 UNION ALL SELECT request_id, 'rank_observations[0].position', 'is below 1' FROM m WHERE k % 1100 = 0 UNION ALL SELECT request_id, 'rank_observations[0].position', 'is above 1000' FROM m WHERE k % 1100 > 1000
 UNION ALL SELECT request_id, 'rank_observations[0]', 'is of no submitted URL' FROM m WHERE t = 'nowhere' AND NOT list_contains(vs, r))
SELECT request_id, path, problem, count(*) AS times FROM f GROUP BY ALL""",
}
