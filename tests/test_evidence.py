"""Spans and selectors, bundles, chains, histories, fingerprints, structural checks, frontiers and reports on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia import api
from evidentia.functions.html import parse_page, parse_pages
from evidentia.operators import artifacts, compare, constraints, coverage, evidence, exports, frontier, lineage, page_analysis


def test_spans_and_snippets(spark):
    text = "x" * 60 + " serving Upper Town,  call us at +1 (555) 123-4567\n or mail a.b@c.example now " + "y" * 60
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a\x01b c@d.ee")], "k long, text string")
    got = {r["k"]: [(s["start"], s["text"]) for s in r["s"]] for r in df.select("k", F.coalesce(coverage.spans(F.col("text"), coverage.EMAIL), F.array()).alias("s")).collect()}
    assert got == {1: [(text.index("a.b@"), "a.b@c.example")], 2: [], 3: [], 4: [(4, "c@d.ee")]}
    source = F.struct(F.lit("visibleText").alias("field"), F.col("text").alias("text"), F.lit("body").alias("selector"))
    found = df.where("k = 1").select(F.inline(coverage.text_signals(source))).collect()
    place = next(r for r in found if r["kind"] == "location")
    at = text.index("serving")
    assert place["term"] == "Upper Town" and place["snippet"] == " ".join(text[at - 45 : at + len("serving Upper Town") + 45].split()) and place["selector"] == "body"
    assert all(r["term"] in r["snippet"] or r["kind"] == "location" for r in found) and {"contact", "location"} <= {r["kind"] for r in found}


def test_selectors_and_block_errors():
    html = '<h2>a</h2><div><h2>b</h2><h3>c</h3><h2>d</h2></div><h2>e</h2><img src=x><p><img alt=""></p><script type="application/ld+json">{"a": [1,\n2 3]}</script><script type="application/ld+json"> </script><script type="application/ld+json">' + "[" * 100_000 + "</script>"
    p = parse_page(html, "https://x.example/")
    assert [h["selector"] for h in p["headings"]] == ["h2:nth-of-type(1)", "h2:nth-of-type(1)", "h3:nth-of-type(1)", "h2:nth-of-type(2)", "h2:nth-of-type(2)"]
    assert [i["selector"] for i in p["images"]] == ["img:nth-of-type(1)", "img:nth-of-type(2)"]
    blocks = p["json_ld"]
    assert not any(b["valid"] for b in blocks) and "line 2, column 3" in blocks[0]["error"] and blocks[1]["error"] == "the block is empty" and blocks[2]["error"] and blocks[2]["selector"].endswith("(3)")


def _site(title, words, extra=""):
    return f"<html lang=en><head>{title}</head><body><h1>T</h1><p>{'word ' * words}</p>{extra}</body></html>"


def test_comparison_has_all_gaps_with_evidence(spark):
    full = _site("<title>A long enough title for a page here</title><meta name=description content='d'>", 400, "<h2>What is a repair?</h2><p>Our service. Call us: +1 555 123 4567</p><script type='application/ld+json'>{\"@type\": \"Dentist\", \"name\": \"N\"}</script>")
    rows = [(1, 9, 0, "https://t.example/", _site("<title>Short</title>", 120), 404, 200), (2, 9, 1, "https://c.example/", full, 200, 200), (3, 9, 2, "https://d.example/", _site("<title>Another title that is long enough</title>", 300), 200, None)]
    pages = spark.createDataFrame(rows, "page_id long, run_id long, input_order int, url string, html string, robots_txt_status_code int, sitemap_xml_status_code int")
    c = api.compare(pages)
    assert {r["number"] for r in c.metrics.where("metric = 'robotsTxtStatusCode'").collect()} == {404.0, 200.0}
    found = {r["rule_id"]: r for r in c.conclusions.collect()}
    only = found["GAP_COMPETITOR_ONLY_SCHEMA"]
    assert only["missing"] == ["dentist"] and only["confidence"] == "medium" and only["category"] == "schema" and found["GAP_CONTENT_BREADTH"]["confidence"] == "high"
    behind = {r["rule_id"]: r for r in c.evidence.collect()}
    assert set(behind) == set(found)
    types = behind["GAP_COMPETITOR_ONLY_SCHEMA"]
    assert [(b["input_order"], b["benchmark"], json.loads(b["observed_value"])) for b in types["competitors"]] == [(1, True, ["Dentist"]), (2, False, [])]
    words = behind["GAP_CONTENT_BREADTH"]
    assert words["target_evidence"][0]["selector"] == "body" and [b["benchmark"] for b in words["competitors"]] == [True, False] and len(words["target_evidence"][0]["snippet"]) == 300
    asked = behind["GAP_COMPETITOR_ONLY_QUESTIONS"]["competitors"][0]["pieces"]
    assert asked[1]["field"] == "detectedQuestions[0]" and asked[1]["snippet"] == "What is a repair?"
    signals = behind["GAP_CONTACT_SIGNALS"]["competitors"][0]["pieces"]
    assert len(signals) > 1 and "555" in "".join(p["snippet"] for p in signals[1:])
    assert evidence.incomplete(c.evidence, c.sites).isEmpty()
    broken = c.evidence.withColumn("competitors", F.when(F.col("rule_id") == "GAP_CONTENT_BREADTH", F.slice("competitors", 2, 1)).otherwise(F.col("competitors")))
    assert [r["rule_id"] for r in evidence.incomplete(broken, c.sites).collect()] == ["GAP_CONTENT_BREADTH"]
    drafts = {r["rule_id"]: r for r in c.proposals.collect()}
    assert "the target has" in drafts["GAP_CONTENT_BREADTH"]["draft"] and drafts["GAP_DESCRIPTION_MISSING"]["draft"] == artifacts.FORMS["meta-description"] and set(drafts) == {r for r in found if found[r]["kind"] == "gap"}
    records = evidence.raw_records(page_analysis.analyze(parse_pages(pages.select("page_id", "url", "html"))))
    assert records.groupBy("page_id").count().where("count <> 25").isEmpty() and records.where("field = 'title' and page_id = 1").first()["observed_value"] == "Short"


def test_chains(spark):
    n = 1000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    data = [(ids[i], ids[i - 1] if i else None) for i in range(n)] + [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000), (6000, 6000), (7000, 9999), (7001, 7000)] + [(8000 + i, ids[0]) for i in range(200)]
    got = {r["run_id"]: (r["root"], r["position"], r["problem"]) for r in lineage.chains(spark.createDataFrame(data, "run_id long, previous_id long")).collect()}
    assert all(got[x] == (ids[0], i, None) for i, x in enumerate(ids)) and all(got[8000 + i] == (ids[0], 1, None) for i in range(200))
    assert all(got[x] == (None, None, "cycle") for x in (5000, 5001, 5002, 5003, 6000)) and got[7000] == (7000, 0, "unknown previous run") and got[7001] == (7000, 1, None)
    assert lineage.chains(spark.createDataFrame([], "run_id long, previous_id long")).isEmpty()
    with pytest.raises(ValueError):
        lineage.chains(spark.createDataFrame([(1, None), (1, 2)], "run_id long, previous_id long"))


def test_legacy_sites(spark):
    runs = spark.createDataFrame([(1, "https://T.example/#x", ["https://c.example/?utm_source=a", "https://gone.example/"]), (2, "https://t.example/", None)], "run_id long, target_url string, competitor_urls array<string>")
    stored = spark.createDataFrame([(2, "target", 0, "https://t.example/", "https://t.example/", "https://t.example/f", True)], "run_id long, role string, input_order int, input_url string, normalized_url string, final_url string, usable boolean")
    pages = spark.createDataFrame([(1, "https://t.example", "https://t.example/", "https://t.example/home", True), (1, "https://c.example", "https://c.example/", "https://c.example/", True)], "run_id long, requested_url string, normalized_url string, final_url string, usable boolean")
    got = sorted(tuple(r) for r in lineage.legacy_sites(runs, stored, pages).select("run_id", "input_order", "role", "final_url", "usable", "known").collect())
    assert got == [(1, 0, "target", "https://t.example/home", True, True), (1, 1, "competitor", "https://c.example/", True, True), (1, 2, "competitor", "https://gone.example/", False, False), (2, 0, "target", "https://t.example/f", True, True)]


def test_fingerprints_open_only_what_differs(spark):
    rows = [(r, f"f{k % 3}", str(k), [k, k + 1]) for r in range(20) for k in range(6)] + [(3, "f0", "0", [0, 1])]
    schema = "run_id long, field string, new string, parts array<int>"
    again = spark.createDataFrame(rows, schema)
    stored = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), schema).select("parts", "field", "run_id", "new")
    assert lineage.altered(stored, again).isEmpty()
    bad = spark.createDataFrame([(r, f, "9" if (r, k) == (7, 5) else k, [*p][::-1] if (r, k) == (8, 2) else p) for r, f, k, p in ((*x[:2], int(x[2]), x[3]) for x in rows) if r != 9], "run_id long, field string, new string, parts array<int>").unionByName(spark.createDataFrame([(99, "f", "n", [1])], schema))
    assert {r["run_id"]: r["problem"] for r in lineage.altered(bad, again).collect()} == {8: "differs", 7: "differs", 9: "not stored", 99: "not expected"}
    found = lineage.opened(bad, again).where("run_id in (7, 8)").collect()
    assert len(found) == 4 and {r["side"] for r in found} == {"stored", "expected"}
    # Two rows that are altered alike, or a row that stands once more, don't cancel out.
    assert lineage.altered(again.unionByName(again.where("run_id = 1").limit(1)).unionByName(again.where("run_id = 1").limit(1)), again).count() == 1


def test_references_and_rank_scope(spark):
    sites = spark.createDataFrame([(1, "https://a.example/", 0, "https://a.example/x"), (1, "https://b.example/", 1, "https://b.example/")], "run_id long, site_key string, input_order int, final_url string")
    changes = spark.createDataFrame([(1, "https://a.example/", "https://a.example/x"), (1, "https://b.example/", "https://other.example/"), (1, "https://z.example/", None), (2, "https://a.example/", None)], "run_id long, site_key string, final_url string")
    assert sorted((r["run_id"], r["site_key"], r["problem"]) for r in lineage.lost_references(changes, sites).collect()) == [(1, "https://b.example/", "another final URL"), (1, "https://z.example/", "no such site"), (2, "https://a.example/", "no such site")]
    before = spark.createDataFrame([(1, "https://old.example/", 0), (1, "https://a.example/", 1)], "run_id long, site_key string, input_order int")
    keys = lineage.rank_keys(before, sites)
    assert [r["site_key"] for r in keys.orderBy("place").collect()] == ["https://a.example/", "https://b.example/", "https://old.example/"]
    ranks = spark.createDataFrame([(1, "https://A.example", 3), (1, "https://nobody.example/", 1)], "run_id long, url string, position int")
    assert [r["position"] for r in lineage.scoped_ranks(ranks.withColumn("url", F.concat("url", F.lit("/"))), keys).collect()] == [3]


_RUN = "run_id string, target_url string, created_at timestamp, competitor_urls array<string>, query_label string, sites array<struct<role:string,input_order:int,normalized_url:string,final_url:string,status:string,usable:boolean,reasons:array<string>>>, conclusions array<struct<kind:string,rule_id:string,priority:string,effort:string>>"


def _run(**changes):
    import datetime as dt

    site = lambda i, **xs: {"role": "competitor" if i else "target", "input_order": i, "normalized_url": f"https://s{i}.example/", "final_url": f"https://s{i}.example/", "status": "eligible", "usable": True, "reasons": []} | xs
    base = {"run_id": "r", "target_url": "https://s0.example/", "created_at": dt.datetime(2026, 1, 1), "competitor_urls": ["https://s1.example/"], "query_label": None, "sites": [site(0), site(1)], "conclusions": [{"kind": "gap", "rule_id": "GAP_X", "priority": "high", "effort": "low"}]}
    for path, value in changes.items():
        at, keys = base, [int(k) if k.isdigit() else k for k in path.split("__")]
        for k in keys[:-1]:
            at = at[k]
        at[keys[-1]] = value
    return base


#: A change of a sound run, and the paths that then have a problem.
BROKEN = [
    ({}, []), ({"run_id": None}, ["run_id"]), ({"target_url": "x"}, ["target_url"]), ({"target_url": "https://x.example/" + "a" * 2048}, ["target_url"]), ({"created_at": None}, ["created_at"]), ({"competitor_urls": []}, ["competitor_urls"]), ({"competitor_urls": None}, ["competitor_urls"]),
    ({"competitor_urls": ["https://a.example", "https://A.example/"]}, ["competitor_urls"]), ({"competitor_urls": ["https://a.example/", None]}, ["competitor_urls[1]"]), ({"query_label": "q" * 201}, ["query_label"]), ({"sites": []}, ["sites"]),
    ({"sites__1__role": "other"}, ["sites[1].role"]), ({"sites__1__role": "target"}, ["sites[1]"]), ({"sites__1__input_order": 0}, ["sites", "sites[1]"]), ({"sites__1__input_order": 6}, ["sites[1].input_order"]), ({"sites__0__final_url": None}, ["sites[0].final_url"]),
    ({"sites__0__status": "fine"}, ["sites[0].status"]), ({"sites__0__usable": None}, ["sites[0].usable"]), ({"sites__0__usable": False}, ["sites[0]"]), ({"sites__1__reasons": [" "]}, ["sites[1]", "sites[1].reasons[0]"]), ({"sites__1__reasons": None}, ["sites[1].reasons"]),
    ({"sites__1__normalized_url": "ftp://x"}, ["sites[1].normalized_url"]), ({"conclusions__0__kind": "rumour"}, ["conclusions[0].kind"]), ({"conclusions__0__rule_id": "X"}, ["conclusions[0].rule_id"]), ({"conclusions__0__priority": None}, ["conclusions[0].priority"]), ({"conclusions__0__effort": "some"}, ["conclusions[0].effort"]),
]


def test_every_field_of_a_run_is_checked(spark):
    data = [_run(**change) | {"run_id": f"r{i}" if change.get("run_id", "") is not None else None} for i, (change, _) in enumerate(BROKEN)]
    rows = spark.createDataFrame([tuple(json.loads(json.dumps(d, default=str)).get(k) if k != "created_at" else d[k] for k in ("run_id", "target_url", "created_at", "competitor_urls", "query_label", "sites", "conclusions")) for d in data], _RUN)
    got = {}
    for r in constraints.violations(rows.withColumn("n", F.monotonically_increasing_id()).withColumn("id", F.coalesce("run_id", F.lit("r1"))), constraints.RUN, "id").collect():
        got.setdefault(r["id"], set()).add(r["path"])
    for i, (change, paths) in enumerate(BROKEN):
        assert got.get(f"r{i}", set()) == set(paths), (change, got.get(f"r{i}"))


def test_requests_are_checked(spark):
    url = "https://x.example/"
    sound = {"target_url": url, "query": "q", "engine": "e", "location": "l", "device": "mobile", "observation_date": "2026-02-01", "observed_rank": 5, "citation_url": None, "notes": None}
    bad = {"target_url": "x", "query": " ", "engine": None, "location": "l" * 201, "device": "watch", "observation_date": "2026-13-01", "observed_rank": 0, "citation_url": "nowhere", "notes": "n" * 2001}
    schema = "id long, " + ", ".join(f"{k} {'int' if k == 'observed_rank' else 'string'}" for k in sound)
    rows = spark.createDataFrame([(0, *sound.values()), *[(i, *(sound | {k: v}).values()) for i, (k, v) in enumerate(bad.items(), 1)]], schema)
    got = {r["id"]: r["path"] for r in constraints.violations(rows, constraints.REQUESTS["visibility"], "id").collect()}
    assert got == dict(enumerate(bad, 1))
    crawl = spark.createDataFrame([(1, url, 50, 5), (2, url, 51, 6), (3, None, 0, -1)], "id long, target_url string, max_pages int, max_depth int")
    assert sorted((r["id"], r["path"]) for r in constraints.violations(crawl, constraints.REQUESTS["crawl"], "id").collect()) == [(2, "max_depth"), (2, "max_pages"), (3, "max_depth"), (3, "max_pages"), (3, "target_url")]
    assert constraints.unknown(crawl.withColumn("extra", F.lit(1)), constraints.REQUESTS["crawl"], "id") == ["extra"]
    pair = spark.createDataFrame([(1, url, ["https://y.example"], [(url, 3)]), (2, url, ["https://X.example"], [("https://z.example/", 3)])], "id long, target_url string, competitor_urls array<string>, rank_observations array<struct<url:string,position:int>>")
    assert sorted((r["id"], r["path"], r["problem"]) for r in constraints.compare_requests(pair, "id").collect()) == [(2, "competitor_urls", "holds the target"), (2, "rank_observations[0]", "is of no submitted URL")]


def _plain_crawl(start, maps, final, links, blocked, most, depth):
    """The queue of one site, one URL at a time."""
    site = start.rsplit("/", 1)[0] if start.count("/") == 3 else "/".join(start.split("/")[:3])
    queue = [(start, 0)] + [(u, 0) for u in sorted(maps)]
    queued, seen, out = {u for u, _ in queue}, set(), []
    while queue and len(out) < most:
        u, d = queue.pop(0)
        if blocked(u):
            out.append((u, d, "blocked"))
        elif final.get(u) is None:
            out.append((u, d, "error"))
        elif final[u] in seen:
            out.append((u, d, "skipped"))
        else:
            seen.add(final[u])
            out.append((u, d, "analyzed"))
            for to in links.get(u, ()) if d < depth else ():
                if to.startswith(site + "/") and to not in queued:
                    queued.add(to)
                    queue.append((to, d + 1))
    return out, bool(queue)


def test_crawls_of_many_sites_equal_queues(spark):
    rng, pages, links, targets, maps, robots, want = random.Random(3), [], [], [], [], [], {}
    for s in range(40):
        u = lambda k, s=s: f"https://s{s}.example/{k}"
        n = rng.randint(1, 25)
        final = {u(k): None if rng.random() < 0.15 else u(rng.randrange(n) if rng.random() < 0.2 else k) for k in range(n)}
        out = {u(k): [u(rng.randrange(n)) if rng.random() < 0.85 else "https://s0.example/0" for _ in range(rng.randint(0, 4))] for k in range(n)}
        listed = [u(rng.randrange(n)) for _ in range(rng.randint(0, 6))]
        targets.append((u(0),))
        pages += list(final.items())
        links += [(a, b, i) for a, bs in out.items() for i, b in enumerate(bs)]
        maps += [(f"https://s{s}.example", x) for x in listed]
        robots.append((f"https://s{s}.example", "User-agent: *\nDisallow: /1\nAllow: /11"))
        blocked = lambda x: x.split("/")[3].startswith("1") and not x.split("/")[3].startswith("11")
        want[f"https://s{s}.example"] = _plain_crawl(u(0), set(listed), final, out, blocked, 7, 3)
    got = frontier.crawl_sites(spark.createDataFrame(targets, "url string"), spark.createDataFrame(pages, "url string, final_url string"), spark.createDataFrame(links, "url string, target string, ordinal int"), frontier.robots_table(spark.createDataFrame(robots, "origin string, body string")), spark.createDataFrame(maps, "origin string, url string"), 7, 3)
    records = {}
    for r in got.records.orderBy("site", "ordinal").collect():
        records.setdefault(r["site"], []).append((r["url"], r["depth"], r["outcome"]))
    assert records == {s: rows for s, (rows, _) in want.items()}
    assert {r["site"]: (r["truncated"], r["status"]) for r in got.sites.collect()} == {s: (cut, "partial" if cut or any(x[2] != "analyzed" for x in rows) else "complete") for s, (rows, cut) in want.items()}
    none = frontier.crawl_sites(spark.createDataFrame([(None,), ("mailto:x",)], "url string"), spark.createDataFrame(pages, "url string, final_url string"), spark.createDataFrame(links, "url string, target string, ordinal int"))
    assert none.records.isEmpty() and none.sites.isEmpty()


def test_reports_are_numbered_across_ranges(spark, tmp_path):
    rows = [("r2", k) for k in range(500)] + [("r1", k) for k in range(30)] + [("r3", 0)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "report string, k long").withColumn("line", F.concat_ws("-", "report", "k")).repartition(7)
    got = exports.numbered(df, ["k"], "report")
    assert got.where("number <> k").isEmpty() and got.count() == len(rows)
    assert sorted(r["number"] for r in exports.numbered(df, ["report", "k"]).collect()) == list(range(len(rows)))
    exports.write(got, str(tmp_path / "out"), "\r\n")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.decode().split("\r\n") == [f"{r}-{k}" for r, k in sorted(rows)] + [""]
    assert exports.numbered(df.limit(0), ["k"], "report").isEmpty()
