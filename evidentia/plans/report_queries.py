"""Whole reports line by line: regions as research runs of their nations, the search facts of ``events`` as a project's growth report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import artifacts, compare, exports, facts, opportunities
from evidentia.plans import fact_queries, run_queries


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``runs, sites, metrics, findings``: each segment of a nation's customers with a balance below zero is a finding."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = read("nation")
    first = n.groupBy(F.col("n_regionkey").alias("run_id")).agg(F.min("n_nationkey").alias("t"))
    url = lambda k: F.concat(F.lit("https://n"), k.cast("string"), F.lit(".example/"))
    runs = first.select("run_id", url(F.col("t")).alias("target_url"))
    placed = n.select("n_nationkey", F.col("n_regionkey").alias("run_id")).join(first, "run_id")
    order = F.when(F.col("n_nationkey") == F.col("t"), 0).otherwise(F.col("n_nationkey") + 1)
    sites = placed.select("run_id", order.alias("input_order"), url(F.col("n_nationkey")).alias("final_url"), "n_nationkey", F.when(order == 0, "target").otherwise("competitor").alias("role"), F.lit("eligible").alias("eligibility"))
    low = read("customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    found = low.join(sites.select("run_id", "input_order", "n_nationkey"), "n_nationkey")
    findings = found.select("run_id", "input_order", F.col("c_mktsegment").alias("rule_id"), F.lit("1.0.0").alias("rule_version"), F.concat(F.lit('"low" | '), F.col("n").cast("string")).alias("problem"))
    metrics = run_queries._nation_metrics(spark, sf_dir).withColumn("label", F.lit(None).cast("string"))
    return runs, sites, metrics, findings


def research_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, sites, metrics, findings = _nations(spark, sf_dir)
    found = compare.conclusions(metrics)
    rows = exports.research_rows(runs, sites, metrics, findings, found, artifacts.written(compare.proposals(found), found))
    return exports.csv_lines(rows)


def research_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, sites, metrics, findings = _nations(spark, sf_dir)
    found = compare.conclusions(metrics)
    counted = sites.join(findings.groupBy("run_id", "input_order").agg(F.count("*").alias("findings")), ["run_id", "input_order"], "left").fillna(0, ["findings"])
    return exports.research_markdown(runs, counted, metrics, found, artifacts.written(compare.proposals(found), found))


def _growth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``projects, metrics, opportunities`` with ids that SQL can spell: rows by number, opportunities by rule, page and query."""
    metrics, _ = facts.split_duplicates(fact_queries._search(spark, sf_dir))
    found = opportunities.opportunities(metrics).where("rule_id <> 'SEARCH_QUERY_MULTIPLE_PAGES'")
    found = found.withColumns({"opportunity_id": F.concat_ws(":", "rule_id", "page", "query"), "status": F.lit("new"), "calculation": F.concat(F.lit("=row "), F.col("row_number").cast("string"))})
    projects = metrics.select("project_id").distinct().withColumns({"target_url": F.lit("https://x.example/a|b"), "generated_at": F.lit("2026-01-01")})
    return projects, metrics.withColumn("metric_id", F.concat(F.lit("m"), F.lpad(F.col("row_number").cast("string"), 9, "0"))), found


def growth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.csv_lines(exports.growth_rows(*_growth(spark, sf_dir)), safe=True)


def growth_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, metrics, found = _growth(spark, sf_dir)
    counts = metrics.groupBy("project_id").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("import_id").alias("imports"), F.count("*").alias("records"))
    counts = counts.join(found.groupBy("project_id").agg(F.count("*").alias("opportunities")), "project_id", "left")
    return exports.growth_markdown(projects, counts, found)


QUERIES = {f.__name__: f for f in (research_csv, research_markdown, growth_csv, growth_markdown)}

_text = lambda s: "'" + s.replace("'", "''") + "'"
_ARTIFACT = {"CONTENT_BREADTH": ("page-brief", "content"), "IMAGE_ALT": ("image-alt-guidance", ""), "QUESTION_COVERAGE": ("visible-faq-and-jsonld", ""), "TRUST_SIGNALS": ("provider-or-reviewer-block", "")}
_METRIC = {"CONTENT_BREADTH": "wordCount", "IMAGE_ALT": "imagesMissingAltCount", "QUESTION_COVERAGE": "questionCount", "TRUST_SIGNALS": "hasTrustSignals"}
_case = lambda pick: "CASE replace(rule_id, 'GAP_', '') " + " ".join(f"WHEN '{r}' THEN {_text(pick(r))}" for r in _ARTIFACT) + " END"
_DRAFT = f"replace(replace({_case(lambda r: artifacts.FORMS[_ARTIFACT[r][0]])}, '{{rule}}', rule_id), '{{difference}}', 'the target has ' || target || ', the benchmark ' || benchmark)"
_REVIEW = _case(lambda r: artifacts.REVIEW["professional" if _ARTIFACT[r][0] in compare.PROFESSIONAL else "editorial"])
_RUN = f"""concl AS ({run_queries.ORACLE_SQL['benchmark_gaps']}),
st AS (SELECT n_regionkey AS run_id, n_nationkey AS k, CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN 0 ELSE n_nationkey + 1 END AS o, 'https://n' || n_nationkey || '.example/' AS url, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS t FROM nation),
rs AS (SELECT DISTINCT run_id, 'https://n' || t || '.example/' AS target FROM st),
mt AS (SELECT run_id, o, url, count(*) AS words, count(*) FILTER (WHERE c_acctbal < 0) AS alt, count(*) FILTER (WHERE c_acctbal > 9900) AS trust FROM st JOIN customer ON c_nationkey = k GROUP BY ALL),
fd AS (SELECT run_id, o, url, c_mktsegment AS rule_id, count(*) AS n FROM st JOIN customer ON c_nationkey = k WHERE c_acctbal < 0 GROUP BY ALL),
gp AS (SELECT c.*, rs.target AS url FROM concl c JOIN rs USING (run_id) WHERE kind = 'gap'),
pr AS (SELECT run_id, url, rule_id, {_DRAFT} AS draft, {_REVIEW} AS review, {_case(lambda r: _ARTIFACT[r][0])} AS type FROM gp)"""
_q = lambda *xs: " || ',' || ".join(f"'\"' || replace(coalesce(({x})::VARCHAR, ''), '\"', '\"\"') || '\"'" for x in xs)
_L = {k: _text(v) for k, v in exports.LIMITS.items()}
_NUMBERED = " SELECT report::VARCHAR AS report, row_number() OVER (PARTITION BY report ORDER BY s, a, b, c) - 1 AS number, line FROM x"
_METRIC_ROWS = ((23, "wordCount", "words"), (24, "questionCount", "trust"), (34, "imagesMissingAltCount", "alt"), (39, "hasTrustSignals", "trust"))
_GOOD = f"""{fact_queries._ROWS}, {fact_queries._RULES.split(' UNION ALL SELECT event_id + 1')[0]}),
op AS (SELECT *, rule_id || ':' || page || ':' || query AS id, CASE WHEN rule_id = 'SEARCH_PAGE_TWO_DEMAND' THEN 'medium' ELSE 'high' END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, page, query ORDER BY row_number) AS j FROM found WHERE rule_id IS NOT NULL) WHERE j = 1)"""
_safe = lambda x: f"CASE WHEN {x} LIKE '=%' THEN '''' || {x} ELSE {x} END"


def _listed(section: int, table: str, report: str, key: str, lines: list[str]) -> str:
    return f"SELECT {report} AS report, {section} AS s, {key} AS a, i - 1 AS b, '' AS c, ls[i] AS line FROM (SELECT *, [{', '.join(lines)}] AS ls, unnest(range(1, {len(lines) + 1})) AS i FROM {table})"


ORACLE_SQL = {
    "research_csv": f"""WITH {_RUN}, x AS (SELECT run_id AS report, 0 AS s, 0 AS a, 0 AS b, '' AS c, {_q(*map(_text, exports.RESEARCH))} AS line FROM rs
 {' '.join(f"UNION ALL SELECT run_id, 1, o, {at}, '', {_q(_text('comparison-metric'), 'url', _text(m), v, 'url', _L['comparison-metric'])} FROM mt" for at, m, v in _METRIC_ROWS)}
 UNION ALL SELECT run_id, 1, o, 1000, rule_id, {_q(_text('finding'), 'url', "rule_id || '@1.0.0'", "'\"low\" | ' || n", 'url', _L['finding'])} FROM fd
 UNION ALL SELECT run_id, 2, 0, 0, rule_id, {_q(_text('comparison-gap'), 'url', 'rule_id', "target || ' / ' || benchmark", 'url', _L['comparison-gap'])} FROM gp
 UNION ALL SELECT run_id, 3, 0, 0, rule_id, {_q(_text('proposal'), 'url', "'PROPOSAL_' || rule_id", 'draft', 'url', 'review')} FROM pr){_NUMBERED}""",
    "research_markdown": f"""WITH {_RUN}, nf AS (SELECT st.run_id, st.o, st.url, count(fd.rule_id) AS n FROM st LEFT JOIN fd ON fd.url = st.url GROUP BY ALL),
ids AS (SELECT rs.run_id, string_agg(rule_id, ', ' ORDER BY rule_id) FILTER (WHERE kind = 'advantage') AS adv, string_agg(rule_id, ', ' ORDER BY rule_id) FILTER (WHERE kind = 'gap') AS gap, string_agg(rule_id, ', ' ORDER BY rule_id) FILTER (WHERE kind = 'shared') AS shared FROM rs LEFT JOIN concl USING (run_id) GROUP BY 1),
x AS ({_listed(0, 'rs', 'run_id', '0', ["'# Research report'", "''", "'- Run: ' || run_id", "'- Target: ' || target", "''", "'## Pages'", "''", "'| Order | Role | URL | Eligibility | Findings |'", "'| ---: | --- | --- | --- | ---: |'"])}
 UNION ALL SELECT run_id, 1, o, 0, '', '| ' || o || ' | ' || CASE WHEN o = 0 THEN 'target' ELSE 'competitor' END || ' | ' || url || ' | eligible | ' || n || ' |' FROM nf
 UNION ALL {_listed(2, 'rs', 'run_id', '0', ["''", "'## Matrix'", "''", "'| Role | URL | Words | Questions | Answers | Types | Trust |'", "'| --- | --- | ---: | ---: | ---: | ---: | --- |'"])}
 UNION ALL SELECT run_id, 3, o, 0, '', '| ' || CASE WHEN o = 0 THEN 'target' ELSE 'competitor' END || ' | ' || url || ' | ' || words || ' | ' || trust || ' |  |  | ' || CASE WHEN trust > 0 THEN 'Observed' ELSE 'Not observed' END || ' |' FROM mt
 UNION ALL {_listed(4, 'rs', 'run_id', '0', ["''", "'## Gaps'", "''"])}
 UNION ALL SELECT report, s, 0, b, a, line FROM ({_listed(5, 'gp', 'run_id', 'rule_id', ["'### ' || rule_id || ' - ' || " + "CASE replace(rule_id, 'GAP_', '') " + ' '.join(f"WHEN '{r}' THEN '{m}'" for r, m in _METRIC.items()) + " END", "''", "'- Target: ' || target", "'- Benchmark: ' || benchmark", "'- Priority: medium'", "''"])})
 UNION ALL {_listed(6, 'ids', 'run_id', '0', ["'## Groups'", "''", "'- Advantages: ' || coalesce(adv, 'None')", "'- Competitors'' advantages: ' || coalesce(gap, 'None')", "'- Shared gaps: ' || coalesce(shared, 'None')", "''", "'## Proposals'", "''"])}
 UNION ALL SELECT report, s, 0, b, a, line FROM ({_listed(7, 'pr', 'run_id', 'rule_id', ["'### PROPOSAL_' || rule_id || ' - ' || type", "''", _text('> ' + artifacts.LABEL), "''", "'```'", 'draft', "'```'", "''", "'Review: ' || review", "''"])})
 UNION ALL {_listed(8, 'rs', 'run_id', '0', ["'## Limitations'", "''", f"'- ' || {_L['comparison-gap']}", f"'- ' || {_L['finding']}", "''"])})
 SELECT report::VARCHAR AS report, row_number() OVER (PARTITION BY report ORDER BY s, a, c, b) - 1 AS number, line FROM x""",
    "growth_csv": f"""WITH {_GOOD}, x AS (SELECT DISTINCT 'project' AS report, 0 AS s, 0 AS a, '' AS c, {_q(*map(_text, exports.GROWTH))} AS line FROM good
 UNION ALL SELECT 'project', 1, -datediff('day', DATE '1970-01-01', date::DATE), 'm' || lpad(row_number::VARCHAR, 9, '0'), {_q(_text('metric'), _text('project'), "'m' || lpad(row_number::VARCHAR, 9, '0')", _text('search-performance'), 'date', 'page', 'query',
 "'clicks=' || clicks || '; impressions=' || impressions || '; ctr=' || ctr || '; averagePosition=' || position || '; device=' || device || '; country=all'", 'NULL', _text('accepted'), _L['metric'])} FROM good
 UNION ALL SELECT 'project', 2, 0, id, {_q(_text('opportunity'), _text('project'), 'id', 'rule_id', 'NULL', 'page', 'query', 'NULL', "'''=row ' || row_number", _text('new'), _L['opportunity'])} FROM op)
SELECT report, row_number() OVER (ORDER BY s, a, c) - 1 AS number, line FROM x""",
    "growth_markdown": f"""WITH {_GOOD}, pj AS (SELECT count(*) AS n, (SELECT count(*) FROM op) AS m FROM good HAVING count(*) > 0),
x AS ({_listed(0, 'pj', "'project'", "''", ["'# Growth report: https://x.example/a' || chr(92) || '|b'", "''", "'Generated: 2026-01-01'", "'Project: project'", "''", "'## Imports'", "''", "'- Sources: 1'", "'- Imports: 1'", "'- Records: ' || n", "'- Opportunities: ' || m", "''", "'## Opportunities'", "''"])}
 UNION ALL {_listed(1, 'op', "'project'", 'id', ["'### ' || rule_id || ' - ' || page || ' - ' || query", "''", "'- Status: new'", "'- Priority: ' || priority", f"'- Limitation: ' || {_L['opportunity']}", "''"])}
 UNION ALL {_listed(2, 'pj', "'project'", "''", ["'## Limitations'", "''", f"'- ' || {_L['metric']}", f"'- ' || {_L['opportunity']}", "''"])})
SELECT report, row_number() OVER (ORDER BY s, a, b) - 1 AS number, line FROM x""",
}
