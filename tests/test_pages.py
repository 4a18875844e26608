"""Page parsing, rules, analyzers, coverage and eligibility on small pages with exact expectations."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U
from evidentia.functions.html import parse_page, parse_pages
from evidentia.functions.urls import UrlError, canonical_py, is_public_address, is_public_v4, normalize_py, resolve_py
from evidentia.operators import coverage, eligibility, page_analysis, rules

PAGE = """<!doctype html><html lang="en"><head><title> Aligner &amp; care </title><meta name="description" content="Treatment in Springfield">
<meta name="robots" content="index, follow"><meta name="viewport" content=""><link rel="alternate canonical" href="https://clinic.example/a#x">
<meta property="og:site_name" content="Clinic"><script type="application/ld+json">{"@graph":[{"@type":["Organization","Dentist"],"name":"Clinic Ltd","telephone":"123"},
{"@type":"Question","name":"What is it?","acceptedAnswer":{"text":"A thing."}}]}</script><script type="application/ld+json">{bad</script></head>
<body><nav aria-label="Breadcrumb">Home</nav><h1>How does it work?</h1><p>It works <b>well</b>.<p>Located in New York today. Mail a@b.example now.
<h3></h3><h3>FAQ</h3><h4>faq</h4><ul><li>One<li>Two</ul><div hidden>secret</div><script>var t="</p>";</script>
<a href="/b?x=1#f">Book a visit</a><a href="https://www.clinic.example/">book A visit</a><a href="#top">top</a><a href="mailto:c@d.example?subject=x">mail</a><a href="https://other.example/p"></a>
<img src="/i.png"><img src="j.png" alt=""><img src="k.png" alt="ok"></body></html>"""


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(1, "https://clinic.example/a", PAGE), (2, "https://clinic.example/", "<h1>One</h1><h1>Two</h1>"), (3, "https://clinic.example/c", None), (4, None, "")]
    pages = parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return coverage.with_coverage(page_analysis.analyze(pages)).cache()


def test_full_page(analysed):
    r = analysed.where("page_id = 1").first()
    assert (r["title"], r["title_length"], r["meta_description"], r["document_language"]) == ("Aligner & care", 14, "Treatment in Springfield", "en")
    assert (r["indexability"], r["canonical_status"], r["viewport_present"], r["viewport"]) == ("explicit-index", "match", True, None)
    assert [(h["level"], h["text"]) for h in r["headings"]] == [(1, "How does it work?"), (3, ""), (3, "FAQ"), (4, "faq")]
    assert (r["h1_count"], r["empty_heading_count"], len(r["level_jumps"]), r["repeated_headings"][0]["count"]) == (1, 1, 1, 2)
    assert r["schema_types"] == ["Organization", "Dentist", "Question"] and r["jsonld_error_count"] == 1
    assert "secret" not in r["visible_text"] and "var t" not in r["visible_text"] and "One Two" in r["visible_text"]
    assert r["detected_questions"] == ["How does it work?", "What is it?"]
    assert [(a["question"], a["answer"]) for a in r["direct_answers"]] == [("How does it work?", "It works well."), ("What is it?", "A thing.")]
    assert (r["internal_link_count"], r["external_link_count"], r["empty_anchor_count"]) == (1, 2, 1)
    assert (r["image_count"], r["images_missing_alt"]) == (3, 2) and r["internal_urls"] == ["https://clinic.example/b?x=1"]
    assert r["faq_indicators"] == ["FAQ", "faq"] and r["breadcrumbs"] == ["Home"]


def test_coverage(analysed):
    r = analysed.where("page_id = 1").first()
    assert r["entity_terms"] == ["Clinic Ltd", "Clinic"] and "New York" in r["location_terms"]
    assert {"a@b.example", "123", "c@d.example"} <= set(r["contact_terms"])
    assert "Dentist" in r["trust_terms"]
    assert r["section_terms"] == ["faq"]


def test_findings_and_observations(analysed):
    found = {(r["page_id"], r["rule_id"]) for r in rules.findings(analysed).collect()}
    assert {x for i, x in found if i == 1} == {"TITLE_LENGTH_SHORT", "META_DESCRIPTION_LENGTH_SHORT", "HEADING_EMPTY", "HEADING_LEVEL_JUMP", "HEADING_REPEATED_TEXT", "JSONLD_INVALID", "BREADCRUMB_SCHEMA_MISSING", "INTERNAL_LINKS_LOW", "IMAGE_ALT_MISSING", "EMPTY_ANCHOR_TEXT"}
    assert {"HEADING_MULTIPLE_H1", "TITLE_MISSING", "INTERNAL_LINKS_MISSING", "JSONLD_MISSING"} <= {x for i, x in found if i == 2}
    assert len(rules.rules()) == 34 and len({r.rule_id for r in rules.rules()}) == 34
    o = rules.observations(analysed)
    assert o.groupBy("page_id").count().where("count <> 33").count() == 0
    got = {r["analyzer_id"]: r["status"] for r in o.where("page_id = 1").collect()}
    assert (got["TECH_STRUCTURED_DATA"], got["TECH_IMAGE_ALT"], got["CONTENT_DIRECT_ANSWERS"], got["TRUST_CITATIONS"]) == ("partially-observed", "partially-observed", "observed", "needs-human-review")


def test_findings_have_evidence(analysed):
    """One piece for each faulty item; the first is also the finding's field and observed value."""
    rows = {(r["page_id"], r["rule_id"]): r for r in rules.findings(analysed).collect()}
    title, invalid, alt, empty = (rows[1, x] for x in ("TITLE_LENGTH_SHORT", "JSONLD_INVALID", "IMAGE_ALT_MISSING", "EMPTY_ANCHOR_TEXT"))
    assert [e["field"] for e in title["evidence"]] == ["titleLength", "title"] and title["observed_value"] == str(len(title["evidence"][1]["observed_value"]))
    a = analysed.where("page_id = 1").first()
    assert [e["snippet"] for e in invalid["evidence"]] == [b["raw"][:240] for b in a["json_ld"] if not b["valid"]]
    assert len(alt["evidence"]) == a["images_missing_alt"] and len(empty["evidence"]) == a["empty_anchor_count"]
    assert (invalid["category"], alt["category"], title["category"]) == ("structured-data", "links-media", "metadata")
    same = {(r["page_id"], r["rule_id"]) for r in rules.finding_ids(analysed).collect()}
    assert same == set(rows)


def test_question_noise(spark):
    texts = ["&lt;b&gt;What is care ?", "Buy now?", "How " + "very " * 40 + "long?", "Is it safe?  Are you sure?", None]
    got = [r["q"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.questions(F.col("t")).alias("q")).collect()]
    assert got == [["What is care?"], [], [], ["Is it safe?", "Are you sure?"], []]


def test_broken_html_is_kept():
    p = parse_page("<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table></i>c<br>d &copy;", "https://x.example")
    assert p["visible_text"] == "a b 1 2 3 c d ©"
    assert parse_page(None, None)["title"] is None


@pytest.mark.parametrize(
    "status,title,text,words,evidence,want",
    [
        (403, "x", "x", 500, 6, ("ineligible", "NON_SUCCESS_HTTP")), (200, "Access denied - site", "long " * 300, 300, 6, ("ineligible", "ACCESS_DENIED")),
        (200, "Site", "checking your browser", 3, 1, ("ineligible", "BOT_CHALLENGE")), (200, "Site", "we wrote about checking your browser " + "w " * 300, 306, 5, ("eligible", "")),
        (200, "Captcha required", "", 0, 1, ("ineligible", "CAPTCHA")), (200, "404 not found", "w " * 300, 300, 6, ("ineligible", "ERROR_PAGE")), (200, "404 ways to win", "w " * 300, 300, 6, ("eligible", "")),
        (200, "", "", 0, 0, ("ineligible", "EMPTY_CONTENT")), (200, "", "w " * 60, 60, 0, ("ineligible", "MISSING_PAGE_EVIDENCE")), (200, "T", "w " * 10, 10, 1, ("ineligible", "NEAR_EMPTY_CONTENT")),
        (200, "T", "w " * 30, 30, 3, ("degraded", "NEAR_EMPTY_CONTENT")), (200, "T", "w " * 90, 90, 1, ("degraded", "MISSING_PAGE_EVIDENCE")),
    ],
)
def test_eligibility(spark, status, title, text, words, evidence, want):
    e = spark.createDataFrame([(title, text)], "a string, b string").select(eligibility.classify(F.lit(status), F.col("a"), F.col("b"), F.lit(words), F.lit(evidence)).alias("e")).first()["e"]
    assert (e["status"], ",".join(e["reasons"])) == want and e["usable"] == (want[0] != "ineligible")


def test_urls():
    assert normalize_py(" Example.COM:443/a/../b#c ") == "https://example.com/b"
    assert resolve_py("https://x.example/a/b", "../c?q=1#z") == "https://x.example/c?q=1" and resolve_py("https://x.example", "tel:1") is None
    assert canonical_py("https://x.example/?b=2&utm_source=q&a=1&gclid=3&b=1#f") == "https://x.example/?a=1&b=2&b=1"
    for bad in ("", "ftp://x", "https://"):
        with pytest.raises(UrlError):
            normalize_py(bad)


def test_addresses(spark):
    table = {"8.8.8.8": True, "10.1.2.3": False, "172.32.0.1": True, "172.16.0.1": False, "169.254.1.1": False, "100.64.0.1": False, "198.18.0.9": False, "255.255.255.255": False, "1.2.3.999": False, "x": False}
    got = {r["a"]: r["p"] for r in spark.createDataFrame([(a,) for a in table], "a string").select("a", is_public_v4(F.col("a")).alias("p")).collect()}
    assert got == table and {a: is_public_address(a) for a in table} == table
    for a, ok in (("2606:4700::1", True), ("::1", False), ("fc00::1", False), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("64:ff9b::a00:1", False), ("2002:0a00:0001::1", False), ("2001:db8::1", False)):
        assert is_public_address(a) is ok


def test_canonical_expression_agrees_with_function(spark):
    """Default ports go, others stay; both forms of the crawl's key agree."""
    given = ["https://A.example:443/x?b=1&a=2#f", "http://a.example:80", "http://a.example:443/", "https://a.example:8443/y?utm_source=q&c=3", "https://a.example/?gclid=1"]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    rows = df.select("u", U.canonical(df.u).alias("c"), U.origin(df.u).alias("o")).collect()
    assert [r["c"] for r in rows] == [U.canonical_py(r["u"]) for r in rows]
    assert [r["o"] for r in rows] == ["https://a.example", "http://a.example", "http://a.example:443", "https://a.example:8443", "https://a.example"]
