"""Queries over small odd tables, held against their SQL with nulls, empty texts and spaces told apart."""

import duckdb
import pytest

from evidentia.plans import registry


@pytest.fixture
def agree(spark, tmp_path):
    """Rows of a query over given tables, which have to be those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
        assert rows == sorted(want.fetchall(), key=repr)
        return rows

    return run


def test_questions_of_odd_first_words(spark, agree):
    texts = ["Plain text.", "Éê, è 12.", "", None, "x" * 150, "y" * 400 + " z", "_ a_b", "What is it?"]
    rows = agree("derived_questions", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows[1][1] == "What is  & more?|how are  related?" and rows[3][1] is None


def _pages(spark):
    titles = ["a" * 26 + " b&amp", "a" * 27 + "&quot", "&amp;&amp and &lt", "&amp;lt; &am", "a" * 60 + "&amp;", "Q&amp;A & more", "c&#39;d&#39"]
    head = '<html lang="en"><head><title>{0}</title><meta name="viewport" content="w"></head><body><h1>{0}</h1><p>Text &amp</p></body></html>'
    return spark.createDataFrame([(i, f"https://a.example/{i}", head.format(t)) for i, t in enumerate(titles)], "page_id long, url string, html string")


@pytest.mark.parametrize("name", ["head_findings", "page_titles", "page_records"])
def test_references_without_a_semicolon(spark, agree, name):
    agree(name, pages=_pages(spark))


def test_comparison_rules_are_rows_of_runs(spark, agree):
    orders = spark.range(0, 90).selectExpr("id AS o_orderkey", "(id * 7) % 31 AS o_custkey")
    rows = agree("comparison_rules", orders=orders)
    assert len({r[0] for r in rows}) > 1 and len(rows) == len({(r[0], r[2]) for r in rows}) > 44


def _moved(spark, name, folder):
    """How often the plan of a query over 100,000 orders shuffles rows for a grouping or join."""
    spark.range(0, 100_000).selectExpr("id AS o_orderkey", "id % 31 AS o_custkey").write.parquet(f"{folder}/many/orders.parquet")
    return registry.QUERIES[name](spark, f"{folder}/many")._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_bundles_move_nothing_but_keys(spark, agree, tmp_path):
    agree("gap_evidence", orders=spark.range(0, 90).selectExpr("id AS o_orderkey", "(id * 7) % 31 AS o_custkey"))
    assert _moved(spark, "gap_evidence", tmp_path) == 0


def test_problems_of_bundles_move_only_their_counts(spark, agree, tmp_path):
    agree("evidence_problems", orders=spark.range(0, 90).selectExpr("id AS o_orderkey", "(id * 7) % 31 AS o_custkey"))
    assert _moved(spark, "evidence_problems", tmp_path) == 1


def test_histories_are_derived_once_for_an_audit(spark, agree, tmp_path):
    orders = spark.range(0, 120).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey")
    lines = spark.range(0, 360).selectExpr("id div 3 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "cast((id * 11) % 50 AS double) AS l_quantity", "element_at(array('R', 'N', 'A', 'N'), cast(id * 7 % 4 + 1 AS int)) AS l_returnflag", "0.1D AS l_discount")
    assert agree("history_audit", orders=orders, lineitem=lines)
    plan = registry.QUERIES["history_audit"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan
