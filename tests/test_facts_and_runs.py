"""CSV import, opportunities, store, comparison, history, crawl, reports; and all SQL twins at the smallest size."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import compare, crawl, facts, history, opportunities, reports
from evidentia.plans import registry
from evidentia.sources import csv_facts, store

SF = "/root/testdata/sf0.001"
HEAD = "Query,Page,Date,Clicks,Impressions,CTR,Position,Device,Country\n"


def load(spark, tmp_path, body, name="a.csv"):
    p = tmp_path / name
    p.write_text(body, encoding="utf-8")
    return csv_facts.read(spark, str(p))


def normal(rows, import_id="i1"):
    headers = [c for c in rows.columns if c != "row_number"]
    mapping = facts.suggest_mapping(headers, "search-console-csv")
    facts.check_mapping(mapping, headers, "search-console-csv")
    return facts.normalize(rows, "search-console-csv", mapping, "p", "label", import_id)


def test_import_golden(spark, tmp_path):
    good = '"red, shoes",https://X.example/a?utm_source=z,2026-01-02,2,"1,00",2%,4.5,mobile,us\n'
    rows = load(spark, tmp_path, "﻿" + HEAD + good + good + "q,https://x.example/b,2026-02-30,1,10,0.1,3,,\n" + "=cmd(),https://x.example/c,2026-01-02,1,10,10%,3,,\n" + ",,,,,,,,\n")
    accepted, rejected = facts.split_duplicates(normal(rows))
    a = accepted.collect()
    assert len(a) == 1 and (a[0]["query"], a[0]["page"], a[0]["impressions"], a[0]["ctr"]) == ("red, shoes", "https://x.example/a", 100, 0.02)
    assert [(r["row_number"], r["error_code"]) for r in rejected.orderBy("row_number").collect()] == [(2, "DUPLICATE_RECORD"), (3, "INVALID_VALUE"), (4, "FORMULA_VALUE")]
    again, dup = facts.split_duplicates(normal(rows, "i2"), accepted)
    assert again.count() == 0 and dup.where("error_code = 'DUPLICATE_RECORD'").count() == 2
    c = facts.counters(facts.judge(normal(rows))).first()
    assert (c["accepted"], c["rejected"], c["duplicates"]) == (1, 3, 1)


@pytest.mark.parametrize("body", ["Email,Page\na,b\n", "Campaign Name,Date\na,b\n", "A,a \n1,2\n", "Query,Page\na\n", ""])
def test_bad_files(spark, tmp_path, body):
    with pytest.raises(facts.ImportError_):
        load(spark, tmp_path, body)


def test_preview_and_gate(spark, tmp_path):
    import hashlib

    path = tmp_path / "p.csv"
    path.write_text("Query,Clicks\n" + "".join(f"q{i},{i}\n" for i in range(7)))
    got = csv_facts.preview(spark, str(path), "search-console-csv")
    assert got["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and got["rows"] == 7 and [r["Query"] for r in got["sample"]] == ["q0", "q1", "q2", "q3", "q4"]
    assert got["mapping"] == {"query": "Query", "clicks": "Clicks"} and got["warnings"][0].startswith("Map required field(s): page, date, impressions")
    csv_facts.gate(" A.CSV ", "Text/CSV", 2 * 1024 * 1024)
    for bad in (("a.txt", "text/csv"), ("a.csv", "image/png"), ("a.csv", "text/csv", 2 * 1024 * 1024 + 1)):
        with pytest.raises(facts.ImportError_):
            csv_facts.gate(*bad)
    path.write_bytes(b"Query,Clicks\na\x00b,1\n")
    with pytest.raises(facts.ImportError_):
        csv_facts.read(spark, str(path))


def test_formulas(spark):
    given = {"=1": True, "\t+a": True, "@x": True, "-5": False, "-5.5%": False, "-1,5": False, "-1,234.5": True, "-a": True, "-5 ": True, "a-5": False, "": False}
    df = spark.createDataFrame([(x,) for x in given], "v string")
    assert {r["v"]: r["f"] for r in df.select("v", facts.is_formula(F.col("v")).alias("f")).collect()} == given


def test_numbers(spark):
    got = spark.createDataFrame([("1,234",), ("4.0",), ("-3",), ("2",), ("50%",), ("150%",), ("1",), ("x",)], "v string").select(facts.integer(F.col("v")).alias("i"), facts.ratio(F.col("v")).alias("r"), facts.is_formula(F.col("v")).alias("f")).collect()
    assert [r["i"] for r in got] == [1234, 4, None, 2, None, None, 1, None]
    assert [r["r"] for r in got] == [None, 0.04, None, 0.02, 0.5, None, 1.0, None] and not any(r["f"] for r in got)


def test_multi_page_and_merge(spark, tmp_path):
    rows = load(spark, tmp_path, HEAD + "Shoes,https://x.example/a,2026-01-02,6,60,10%,3,,\nshoes,https://x.example/b,2026-01-02,6,60,10%,3,,\n")
    accepted, _ = facts.split_duplicates(normal(rows))
    found = opportunities.opportunities(accepted)
    r = found.where("rule_id = 'SEARCH_QUERY_MULTIPLE_PAGES'").first()
    assert len(r["metric_ids"]) == 2 and r["page"] is None and opportunities.multi_page(accepted).first()["expression"] == "60 + 60"
    none = found.limit(0).withColumns({"status": F.lit("new"), "created_at": F.lit(1), "updated_at": F.lit(1)})
    stored = opportunities.merge(none, found, F.lit(1))
    stored = opportunities.set_status(stored, r["opportunity_id"], "accepted", F.lit(2))
    merged = opportunities.merge(stored, found, F.lit(3)).where(F.col("opportunity_id") == r["opportunity_id"]).first()
    assert (merged["status"], merged["created_at"], merged["updated_at"]) == ("accepted", 1, 3)
    with pytest.raises(ValueError):
        opportunities.set_status(stored, "x", "done", F.lit(1))


def test_store_versions(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "store"))
    s.replace("t", spark.range(3))
    old = s.read("t")
    s.append("t", spark.range(3, 5))
    assert s.read("t").count() == 5 and old.count() == 3
    with pytest.raises(KeyError):
        s.read("none")


def test_delete_import(spark):
    m = spark.createDataFrame([("i1", "m1"), ("i2", "m2")], "import_id string, metric_id string")
    e = spark.createDataFrame([("o1", "m1"), ("o2", "m2")], "opportunity_id string, metric_id string")
    out = store.delete_import({"metrics": m, "opportunity_evidence": e, "opportunities": e}, "i1")
    assert out["metrics"].count() == 1 and [r["opportunity_id"] for r in out["opportunity_evidence"].collect()] == ["o2"] and out["opportunities"].count() == 2


def metrics(spark, rows):
    return spark.createDataFrame(rows, "run_id long, input_order int, usable boolean, metric string, number double")


def test_comparison(spark):
    m = metrics(spark, [(1, 0, True, "wordCount", 180.0), (1, 1, True, "wordCount", 650.0), (1, 2, False, "wordCount", 9000.0), (1, 0, True, "imagesMissingAltCount", 0.0), (1, 1, True, "imagesMissingAltCount", 2.0),
                        (1, 0, True, "hasTrustSignals", 0.0), (1, 1, True, "hasTrustSignals", 0.0), (1, 0, True, "hasTitle", 0.0), (1, 1, True, "hasTitle", 1.0), (2, 0, False, "wordCount", 1.0), (2, 1, True, "wordCount", 900.0)])
    got = {(r["run_id"], r["kind"], r["rule_id"]): r["benchmark"] for r in compare.conclusions(m).collect()}
    assert got == {(1, "gap", "GAP_CONTENT_BREADTH"): 650.0, (1, "advantage", "ADV_IMAGE_ALT"): 2.0, (1, "shared", "SHARED_GAP_TRUST_SIGNALS"): 0.0, (1, "gap", "GAP_TITLE_MISSING"): 1.0}
    p = {r["rule_id"]: r["artifact_type"] for r in compare.proposals(compare.conclusions(m)).collect()}
    assert p == {"GAP_CONTENT_BREADTH": "page-brief", "GAP_TITLE_MISSING": "title"}
    assert len(compare.metric_columns()) == 43
    s = spark.createDataFrame([(1, 0, True, "eligible"), (1, 1, True, "degraded"), (2, 0, False, "ineligible"), (2, 1, True, "eligible"), (3, 0, True, "eligible"), (3, 1, True, "eligible")], "run_id long, input_order int, usable boolean, eligibility string")
    assert {r["run_id"]: r["status"] for r in compare.status(s).collect()} == {1: "partial", 2: "unavailable", 3: "complete"}


def test_order_moves_golden(spark):
    side = lambda *xs: spark.createDataFrame([(1, x, i) for i, x in enumerate(xs)], "run int, site string, at int")
    moved = lambda a, b: {r["site"] for r in history.order_moves(side(*a), side(*b), "run", "site", "at").collect()}
    assert moved("abc", "cab") == {"a", "b", "c"} and moved("abc", "xac") == set()


def test_verification(spark):
    a = spark.createDataFrame([("T", "observed", "1"), ("U", "observed", "1"), ("V", "observed", "1"), ("W", "x", "1")], "analyzer_id string, status string, version string")
    b = spark.createDataFrame([("T", "not-observed", "1"), ("U", "observed", "2"), ("V", "observed", "1"), ("X", "x", "1")], "analyzer_id string, status string, version string")
    assert {r["analyzer_id"]: r["change"] for r in history.analyzer_changes(a, b).collect()} == {"T": "regressed", "U": "changed", "V": "unchanged", "W": "resolved", "X": "new"}
    art = spark.createDataFrame([("p1", "G1"), ("p2", "G2"), ("p3", "G3")], "artifact_id string, rule_id string")
    gaps = spark.createDataFrame([("G1",), ("G2",)], "rule_id string")
    done = spark.createDataFrame([("p2",)], "artifact_id string")
    assert {r["artifact_id"]: r["change"] for r in history.proposal_links(art, gaps, done, F.lit(True)).collect()} == {"p1": "unchanged", "p2": "regressed", "p3": "resolved"}


def test_robots_and_crawl(spark):
    rules_ = crawl.robots_rules("User-agent: *\nUser-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /private # x\nAllow: /private/ok\nDisallow:\n")
    assert rules_ == [("/private", False), ("/private/ok", True)]
    got = spark.createDataFrame([("/private/a",), ("/private/ok/1",), ("/",)], "p string").select(crawl.allowed(F.col("p"), rules_).alias("a")).collect()
    assert [r["a"] for r in got] == [False, True, True]
    u = lambda x: f"https://x.example/{x}"
    pages = spark.createDataFrame([(u(""), u("")), (u("a"), u("a")), (u("c"), u("a")), (u("f"), None), (u("deep"), u("deep"))], "url string, final_url string")
    links = spark.createDataFrame([(u(""), u("a"), 0), (u(""), u("private/p"), 1), (u(""), u("f"), 2), (u(""), u("c"), 3), (u(""), "https://other.example/", 4), (u("a"), u("deep"), 0)], "url string, target string, ordinal int")
    r = crawl.crawl(spark, u("?utm_source=x"), pages, links, "User-agent: *\nDisallow: /private", max_pages=5)
    assert [(x["url"], x["outcome"]) for x in r.pages.orderBy("ordinal").collect()] == [(u(""), "analyzed"), (u("a"), "analyzed"), (u("private/p"), "blocked"), (u("f"), "error"), (u("c"), "skipped-redirect-duplicate")]
    assert r.status == "partial"
    full = crawl.crawl(spark, u(""), pages, links, max_pages=10)
    assert u("deep") in {x["url"] for x in full.pages.collect()}
    with pytest.raises(ValueError):
        crawl.crawl(spark, u(""), pages, links, max_pages=51)


def test_crawl_of_pages_fetched_many_times(spark):
    u = lambda x: f"https://x.example/{x}"
    pages = spark.createDataFrame([(u(""), u(""))] + [(u("a"), u("a"))] * 300 + [(u("b"), u("b"))], "url string, final_url string").coalesce(1)
    links = spark.createDataFrame([(u(""), u("a"), 0), (u(""), u("b"), 1)], "url string, target string, ordinal int")
    r = crawl.crawl(spark, u(""), pages, links)
    assert [(x["url"], x["outcome"]) for x in r.pages.orderBy("ordinal").collect()] == [(u(""), "analyzed"), (u("a"), "analyzed"), (u("b"), "analyzed")] and r.status == "complete"


def test_report_cells(spark):
    df = spark.createDataFrame([('=1+1', 'a"b|c')], "x string, y string")
    assert reports.csv_lines(df, ["x", "y"]).first()["line"] == '"\'=1+1","a""b|c"'
    assert reports.markdown_lines(df, ["y"]).first()["line"] == '| a"b\\|c |'
    cited = spark.createDataFrame([("finding:1:R:f",), ("made-up",)], "evidence_id string")
    ev = reports.evidence_items(spark.createDataFrame([(1, "u", "R", "f", "v")], "page_id long, url string, rule_id string, field string, observed_value string"))
    assert [r["evidence_id"] for r in reports.ungrounded(cited, ev).collect()] == ["made-up"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run_and_agree_with_sql(spark, name):
    import duckdb
    import pandas as pd

    a = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in "nation customer part orders lineitem events documents pages benchmark".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    b = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    plain = lambda v: "" if v is None or v is pd.NA or v != v else str(v)
    key = lambda d: sorted(tuple(plain(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    norm = lambda ks: [tuple(x.removesuffix(".0") for x in k) for k in ks]
    assert norm(key(a)) == norm(key(b))
