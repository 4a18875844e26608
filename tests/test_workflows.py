"""Discovery, linkage and the workflows end to end."""

from evidentia import api
from evidentia.operators import discovery, linkage


def test_discovery(spark):
    robots = spark.createDataFrame([("https://x.example", "User-agent: *\nSitemap: https://x.example/s.xml\n sitemap: https://x.example/sitemap.xml")], "origin string, body string")
    assert {r["sitemap_url"] for r in discovery.declared_sitemaps(robots).collect()} == {"https://x.example/sitemap.xml", "https://x.example/s.xml"}
    maps = spark.createDataFrame([("https://x.example", "<url><loc> https://x.example/?a=1&amp;b=2 </loc></url><LOC>\n</LOC>"), ("https://x.example", None)], "origin string, body string")
    assert [r["url"] for r in discovery.sitemap_urls(maps).collect()] == ["https://x.example/?a=1&b=2"]
    pages = spark.createDataFrame([(1, "https://X.example/a"), (2, "https://y.example/")], "page_id long, url string")
    res = spark.createDataFrame([("https://x.example/robots.txt", 200), ("https://x.example/sitemap.xml", 404)], "resource_url string, status int")
    got = {r["page_id"]: (r["robots_txt_available"], r["sitemap_xml_available"], r["sitemap_xml_status_code"]) for r in discovery.with_resources(pages, res).collect()}
    assert got == {1: (True, False, 404), 2: (False, False, None)}


def test_ranks_and_detail(spark):
    sites = spark.createDataFrame([(1, 0, "https://x.example/a#z", "https://x.example/b")], "run_id long, input_order int, final_url string, requested_url string")
    ranks = spark.createDataFrame([(1, "https://x.example/b", 7), (1, "https://x.example/a?utm_source=q", 3), (1, "https://x.example/a#z", 5000)], "run_id long, url string, position int")
    assert linkage.with_rank(sites, ranks, ["final_url", "requested_url"]).first()["rank"] == 3
    metrics = spark.createDataFrame([("m1", "red shoes", "https://x.example/a"), ("m2", "hats", "https://x.example/none")], "metric_id string, query string, page string")
    pages = spark.createDataFrame([(0, "https://x.example/a", "https://x.example/a", "A"), (1, "https://x.example/a", "https://x.example/q", "B")], "input_order int, final_url string, normalized_url string, title string")
    opps = spark.createDataFrame([("o2", 5, ["m1"]), ("o1", 9, ["m1", "m2"])], "opportunity_id string, row_number long, metric_ids array<string>")
    gaps = spark.createDataFrame([("g1", "Shoes are missing"), ("g2", "no match")], "gap_id string, gap_text string")
    got = {r["metric_id"]: (r["title"], r["opportunity_id"], r["related_gaps"]) for r in linkage.search_detail(metrics, pages, opps, gaps).collect()}
    assert got == {"m1": ("A", "o2", 1), "m2": (None, "o1", 0)}
    obs = spark.createDataFrame([(3, None), (None, "https://c.example"), (None, None), (2000, "https://c.example")], "rank int, citation_url string")
    assert linkage.visibility_violations(obs).count() == 2
    assert linkage.research_sources(spark).where("analyzer_id = 'TECH_INDEXABILITY'").count() == 2


def test_workflows(spark, tmp_path):
    full = "<html lang=en><head><title>A long enough title for a page here</title><meta name=description content='d'></head><body><h1>T</h1><p>" + "word " * 400 + "</p></body></html>"
    thin = "<html><head><title>Short</title></head><body><h1>T</h1><p>" + "word " * 120 + "</p></body></html>"
    pages = spark.createDataFrame([(1, 9, 0, "https://t.example/", thin), (2, 9, 1, "https://c.example/", full)], "page_id long, run_id long, input_order int, url string, html string")
    c = api.compare(pages)
    assert c.status.first()["status"] == "complete"
    rules = {r["rule_id"] for r in c.conclusions.collect()}
    assert {"GAP_CONTENT_BREADTH", "GAP_DESCRIPTION_MISSING", "GAP_LANGUAGE_MISSING", "SHARED_GAP_TRUST_SIGNALS"} <= rules
    assert c.metrics.groupBy("input_order").count().where("count <> 43").count() == 0
    (tmp_path / "l.csv").write_text("Source,Date,Leads,Qualified Leads\nads,2026-01-01,40,3\nseo,2026-01-01,5,9\n")
    got = api.import_csv(spark, str(tmp_path / "l.csv"), "lead-summary-csv", "p", "leads", "i")
    assert [r["rule_id"] for r in got.opportunities.collect()] == ["LEAD_VOLUME_LOW_QUALIFICATION"]
    assert [(r["row_number"], r["error_field"]) for r in got.rejected.collect()] == [(2, "qualifiedLeads")]
