"""Queries over two snapshots of ``events`` and the relational tables: history, merges, integrity, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import compare, history
from evidentia.sources import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16").cast("timestamp")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


def _keyed(df: DataFrame) -> DataFrame:
    return df.select((F.col("user_id") % 40).alias("site"), F.concat_ws("-", "event_type", F.floor("value").cast("long") % 12).alias("rule_id"))


def finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_keyed, _halves(spark, sf_dir))
    return history.set_changes(a, b, ["site", "rule_id"])


def regressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_keyed, _halves(spark, sf_dir))
    before = b.where("site < 10")
    return history.regressions(history.set_changes(a, b, ["site", "rule_id"]), before, ["site", "rule_id"])


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id")


def _profile(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("user_id") % 50).alias("site")).agg(F.max("event_type").alias("top_type"), F.floor(F.max("value")).cast("long").alias("most"), F.min_by("event_type", "event_id").alias("first_type"))


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_profile, _halves(spark, sf_dir))
    return history.field_changes(a, b, "site", ["top_type", "most", "first_type"])


def _ranks(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("user_id") % 60).alias("site")).agg((F.count("*") % 15).alias("rank")).where("rank > 2")


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_ranks, _halves(spark, sf_dir))
    return history.rank_changes(a, b, "site", "rank")


def _ordered(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("user_id") % 10).alias("run"), (F.floor("value").cast("long") % 9).alias("site")).agg(F.min("event_id").alias("at"))


def order_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_ordered, _halves(spark, sf_dir))
    return history.order_moves(a, b, "run", "site", "at")


def _statuses(df: DataFrame) -> DataFrame:
    n = F.min("event_id") % 4
    state = F.element_at(F.array(*[F.lit(x) for x in ("observed", "partially-observed", "not-observed", "not-applicable")]), (n + 1).cast("int"))
    return df.groupBy((F.col("user_id") % 70).alias("analyzer_id")).agg(state.alias("status"), (F.max("event_id") % 5 == 0).cast("int").alias("version"))


def analyzer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(_statuses, _halves(spark, sf_dir))
    return history.analyzer_changes(a.where("analyzer_id % 11 <> 0"), b.where("analyzer_id % 13 <> 0"))


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    return store.orphans(_table(spark, sf_dir, "orders"), "o_custkey", kept, "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicates(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    metrics = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("import_id"), F.col("o_orderkey").alias("metric_id"))
    out = store.delete_import({"metrics": metrics, "opportunity_evidence": items.select(F.col("l_orderkey").alias("metric_id"), "l_linenumber")}, "1")
    return out["opportunity_evidence"].groupBy("l_linenumber").agg(F.count("*").alias("links"), F.count_distinct("metric_id").alias("metrics"))


def _nation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites of one run by region; the first nation of a region is the target."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("t"))
    n = nation.join(F.broadcast(first), "n_regionkey").select("n_nationkey", F.col("n_regionkey").alias("run_id"), F.when(F.col("n_nationkey") == F.col("t"), 0).otherwise(F.col("n_nationkey") + 1).alias("input_order"))
    c = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("words"), F.count_if(F.col("c_acctbal") < 0).alias("alt"), F.count_if(F.col("c_acctbal") > 9900).alias("trust"))
    j = n.join(c, "n_nationkey").withColumn("usable", F.lit(True))
    m = lambda name, col: F.struct(F.lit(name).alias("metric"), F.col(col).cast("double").alias("number"))
    return j.select("run_id", "input_order", "usable", F.inline(F.array(m("wordCount", "words"), m("imagesMissingAltCount", "alt"), m("hasTrustSignals", "trust"), m("questionCount", "trust"))))


def benchmark_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = compare.conclusions(_nation_metrics(spark, sf_dir))
    return got.select("run_id", "kind", "rule_id", F.col("target").cast("long").alias("target"), F.col("benchmark").cast("long").alias("benchmark"))


def set_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types that later sites of a size have and the first lacks."""
    p = _table(spark, sf_dir, "part")
    v = p.select(F.col("p_size").alias("run_id"), (F.col("p_partkey") % 3).alias("input_order"), F.lit("schemaTypes").alias("metric"), F.col("p_type").alias("value"))
    return compare.set_gaps(v).select("run_id", "value", "sites")


def competitor_only_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sites of a run by size; the third site of some runs isn't usable."""
    p = _table(spark, sf_dir, "part").select(F.col("p_size").alias("run_id"), (F.col("p_partkey") % 3).alias("input_order"), "p_type", "p_brand", "p_name")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in (("schemaTypes", "p_type"), ("topicTerms", "p_brand"), ("detectedQuestions", "p_name"))])
    v = p.select("run_id", "input_order", (~((F.col("input_order") == 2) & (F.col("run_id") % 5 == 0)) & (F.col("run_id") % 7 != 0)).alias("usable"), F.inline(values))
    return compare.competitor_only(v).select("run_id", "rule_id", F.array_join("missing", "|").alias("missing"))


def _sites(df: DataFrame) -> DataFrame:
    site = (F.col("user_id") % 50).alias("site_key")
    made = df.groupBy(site).agg(
        (F.count("*") % 3).alias("status_code"), F.max("event_type").alias("title"), F.floor(F.max("value")).cast("long").alias("word_count"),
        (F.min("event_id") % 4 != 0).alias("usable"), F.collect_set(F.when(F.col("value") > 40, F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))).alias("schema_types"),
    )
    return made.withColumns({"role": F.when(F.col("site_key") % 10 == 0, "target").otherwise("competitor"), "eligibility": F.when(F.col("usable"), "eligible").otherwise("ineligible")})


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs made of the halves of ``events``; schema types are shown in lower case."""
    a, b = map(_sites, _halves(spark, sf_dir))
    tracked = {"technical": ("status_code",), "metadata": ("title",), "content": ("word_count",)}
    shown = lambda c: F.when(F.col("field") == "schema_types", F.lower(c)).otherwise(F.col(c)).alias(c)
    return history.run_diff(a, b, "site_key", tracked).select("site_key", "scope", "category", "field", "change", shown("old"), shown("new"))


QUERIES = {f.__name__: f for f in (finding_changes, regressed_findings, latest_runs, field_changes, rank_changes, order_moves, analyzer_changes, orphan_orders, uniqueness, delete_cascade, benchmark_gaps, set_gaps, competitor_only_gaps, run_diff)}

_AB = "a0 AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), b0 AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')"


def _two(select: str, where: str = "") -> str:
    return f"a AS ({select.format('a0')}{where}), b AS ({select.format('b0')}{where})"


_KEYS = _two("SELECT DISTINCT user_id % 40 AS site, event_type || '-' || (floor(value)::BIGINT % 12) AS rule_id FROM {}")
_CHANGE = "CASE WHEN a.site IS NULL THEN 'new' WHEN b.site IS NULL THEN 'resolved' ELSE 'unchanged' END"
_STATE = "['observed', 'partially-observed', 'not-observed', 'not-applicable'][min(event_id) % 4 + 1]"
_NATIONS = """n AS (SELECT n_nationkey, n_regionkey AS run_id, CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN 0 ELSE 1 END AS o FROM nation),
c AS (SELECT c_nationkey AS n_nationkey, count(*) AS words, count(*) FILTER (WHERE c_acctbal < 0) AS alt, count(*) FILTER (WHERE c_acctbal > 9900) AS trust FROM customer GROUP BY 1),
j AS (SELECT * FROM n JOIN c USING (n_nationkey)),
m AS (SELECT run_id, max(words) FILTER (WHERE o = 0) AS tw, max(words) FILTER (WHERE o = 1) AS bw, max(alt) FILTER (WHERE o = 0) AS ta, min(alt) FILTER (WHERE o = 1) AS ba,
 max((trust > 0)::INT) FILTER (WHERE o = 0) AS tt, max((trust > 0)::INT) FILTER (WHERE o = 1) AS bt, max(trust) FILTER (WHERE o = 0) AS tq, max(trust) FILTER (WHERE o = 1) AS bq FROM j GROUP BY 1)"""


def _gap(rule: str, t: str, b: str, least: int, lower: bool = False) -> str:
    signed = f"({t} - {b})" if lower else f"({b} - {t})"
    return f"SELECT run_id, CASE WHEN {signed} >= {least} THEN 'gap' ELSE 'advantage' END AS kind, CASE WHEN {signed} >= {least} THEN 'GAP_' ELSE 'ADV_' END || '{rule}' AS rule_id, {t}::BIGINT AS target, {b}::BIGINT AS benchmark FROM m WHERE abs({signed}) >= {least}"


_RUNS = """SELECT user_id % 50 AS k, count(*) % 3 AS status_code, max(event_type) AS title, floor(max(value))::BIGINT AS word_count, min(event_id) % 4 <> 0 AS ok,
 list_distinct(list(event_type) FILTER (WHERE value > 40)) AS ts FROM {} GROUP BY 1"""
_RUN_DIFF = f"""WITH {_AB}, {_two(_RUNS)},
j AS (SELECT a.k AS site_key, CASE WHEN a.k % 10 = 0 THEN 'target' ELSE 'competitor' END AS scope, a.ok AND b.ok AS fine, a.ts AS t0, b.ts AS t1, unnest([
  {{'c': 'technical', 'f': 'status_code', 'o': a.status_code::VARCHAR, 'n': b.status_code::VARCHAR}}, {{'c': 'metadata', 'f': 'title', 'o': a.title, 'n': b.title}},
  {{'c': 'content', 'f': 'word_count', 'o': a.word_count::VARCHAR, 'n': b.word_count::VARCHAR}},
  {{'c': 'technical', 'f': 'eligibility', 'o': CASE WHEN a.ok THEN 'eligible' ELSE 'ineligible' END, 'n': CASE WHEN b.ok THEN 'eligible' ELSE 'ineligible' END}}]) AS x FROM a JOIN b USING (k)),
t AS (SELECT DISTINCT site_key, scope, coalesce(t0, []) AS t0, coalesce(t1, []) AS t1 FROM j WHERE fine)
SELECT site_key, scope, x.c AS category, x.f AS field, 'changed' AS change, x.o AS old, x.n AS new FROM j WHERE x.o <> x.n AND (fine OR x.c = 'technical')
UNION ALL SELECT site_key, scope, 'schema', 'schema_types', 'added', NULL, v FROM (SELECT *, unnest(t1) AS v FROM t) WHERE NOT list_contains(t0, v)
UNION ALL SELECT site_key, scope, 'schema', 'schema_types', 'removed', v, NULL FROM (SELECT *, unnest(t0) AS v FROM t) WHERE NOT list_contains(t1, v)"""
_ONLY = """WITH p AS (SELECT p_size AS run_id, p_partkey % 3 AS o, p_type, p_brand, p_name FROM part),
u AS (SELECT *, NOT (o = 2 AND run_id % 5 = 0) AND run_id % 7 <> 0 AS usable FROM p),
v AS (SELECT run_id, o, unnest([{'r': 'GAP_COMPETITOR_ONLY_SCHEMA', 'v': lower(trim(p_type))}, {'r': 'GAP_COMPETITOR_ONLY_TOPICS', 'v': lower(trim(p_brand))}, {'r': 'GAP_COMPETITOR_ONLY_QUESTIONS', 'v': lower(trim(p_name))}]) AS x FROM u WHERE usable),
fit AS (SELECT run_id FROM v GROUP BY 1 HAVING bool_or(o = 0) AND bool_or(o > 0)),
miss AS (SELECT run_id, x.r AS rule_id, x.v AS value FROM v WHERE run_id IN (SELECT run_id FROM fit) GROUP BY ALL HAVING min(o) > 0)
SELECT run_id, rule_id, string_agg(value, '|' ORDER BY value) AS missing FROM miss GROUP BY ALL"""
ORACLE_SQL = {
    "competitor_only_gaps": _ONLY,
    "run_diff": _RUN_DIFF,
    "finding_changes": f"WITH {_AB}, {_KEYS} SELECT coalesce(a.site, b.site) AS site, coalesce(a.rule_id, b.rule_id) AS rule_id, {_CHANGE} AS change FROM a FULL JOIN b ON a.site = b.site AND a.rule_id = b.rule_id",
    "regressed_findings": f"WITH {_AB}, {_KEYS}, x AS (SELECT coalesce(a.site, b.site) AS site, coalesce(a.rule_id, b.rule_id) AS rule_id, {_CHANGE} AS change FROM a FULL JOIN b ON a.site = b.site AND a.rule_id = b.rule_id) SELECT site, rule_id, CASE WHEN change = 'new' AND site < 10 THEN 'regressed' ELSE change END AS change FROM x",
    "latest_runs": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "field_changes": f"WITH {_AB}, {_two('SELECT user_id % 50 AS site, max(event_type) AS top_type, floor(max(value))::BIGINT AS most, arg_min(event_type, event_id) AS first_type FROM {} GROUP BY 1')}, j AS (SELECT a.site, unnest([{{'f': 'top_type', 'o': a.top_type, 'n': b.top_type}}, {{'f': 'most', 'o': a.most::VARCHAR, 'n': b.most::VARCHAR}}, {{'f': 'first_type', 'o': a.first_type, 'n': b.first_type}}]) AS x FROM a JOIN b USING (site)) SELECT site, x.f AS field, x.o AS old, x.n AS new, 'changed' AS change FROM j WHERE x.o <> x.n",
    "rank_changes": f"WITH {_AB}, {_two('SELECT user_id % 60 AS site, count(*) % 15 AS rank FROM {} GROUP BY 1 HAVING count(*) % 15 > 2')} SELECT coalesce(a.site, b.site) AS site, a.rank AS old, b.rank AS new, b.rank - a.rank AS delta FROM a FULL JOIN b ON a.site = b.site WHERE a.rank IS DISTINCT FROM b.rank",
    "order_moves": f"WITH {_AB}, {_two('SELECT user_id % 10 AS run, floor(value)::BIGINT % 9 AS site, min(event_id) AS at FROM {} GROUP BY ALL')}, x AS (SELECT run, site, row_number() OVER (PARTITION BY run ORDER BY a.at)::INT AS old_place, row_number() OVER (PARTITION BY run ORDER BY b.at)::INT AS new_place FROM a JOIN b USING (run, site)) SELECT * FROM x WHERE old_place <> new_place",
    "analyzer_changes": f"WITH {_AB}, {_two(f'SELECT user_id % 70 AS k, {_STATE} AS s, (max(event_id) % 5 = 0)::INT AS v FROM {{}} GROUP BY 1')}, p AS (SELECT * FROM a WHERE k % 11 <> 0), q AS (SELECT * FROM b WHERE k % 13 <> 0) SELECT coalesce(p.k, q.k) AS analyzer_id, p.s AS old, q.s AS new, CASE WHEN p.k IS NULL THEN 'new' WHEN q.k IS NULL THEN 'resolved' WHEN p.v <> q.v THEN 'changed' WHEN p.s = q.s THEN 'unchanged' WHEN p.s IN ('observed', 'not-applicable') AND q.s NOT IN ('observed', 'not-applicable') THEN 'regressed' ELSE 'changed' END AS change FROM p FULL JOIN q ON p.k = q.k",
    "orphan_orders": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1",
    "uniqueness": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "delete_cascade": "SELECT l_linenumber, count(*) AS links, count(DISTINCT l_orderkey) AS metrics FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1) GROUP BY 1",
    "benchmark_gaps": f"WITH {_NATIONS} {_gap('CONTENT_BREADTH', 'tw', 'bw', 100)} UNION ALL {_gap('IMAGE_ALT', 'ta', 'ba', 1, True)} UNION ALL {_gap('QUESTION_COVERAGE', 'tq', 'bq', 1)} UNION ALL {_gap('TRUST_SIGNALS', 'tt', 'bt', 1)} UNION ALL SELECT run_id, 'shared', 'SHARED_GAP_TRUST_SIGNALS', 0, 0 FROM m WHERE tt = 0 AND bt = 0",
    "set_gaps": "SELECT p_size AS run_id, lower(trim(p_type)) AS value, count(DISTINCT p_partkey % 3) AS sites FROM part GROUP BY ALL HAVING min(p_partkey % 3) > 0",
}
