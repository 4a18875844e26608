"""Crawls of all sites of a table at once: over the raw pages, and over an acyclic link graph of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import urls as U
from evidentia.functions.html import parse_pages
from evidentia.operators import frontier, page_analysis
from evidentia.plans.page_queries import ROBOTS

ORDER_ROBOTS = "User-agent: *\nDisallow: /o/1\nAllow: /o/12 # open\n\nUser-agent: other\nDisallow: /\n"


def host_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host from its smallest URL, its sitemap being all its pages; links come from the HTML."""
    parsed = parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).persist()
    own = parsed.select(U.canonical(F.col("url")).alias("url"))
    links = page_analysis.link_edges(parsed).select(U.canonical(F.col("page_url")).alias("url"), U.canonical(F.col("target_url")).alias("target"), "ordinal")
    sites = own.select(U.origin(F.col("url")).alias("origin"), "url")
    rules = frontier.robots_table(sites.select("origin", F.lit(ROBOTS).alias("body")).distinct())
    records = frontier.crawl_sites(own, own.withColumn("final_url", F.col("url")), links, rules, sites, max_pages=12).records
    parsed.unpersist()
    return records


def _order_site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``robots (origin, body), pages, links`` of a site for each customer: its orders link as a heap by key, failed and redirected ones by status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus")
    place = orders.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    site = F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example"))
    at = lambda key: F.concat("site", F.lit("/o/"), key.cast("string"))
    rows = place.select(site.alias("site"), "o_orderkey", "o_orderstatus", "k")
    home = rows.select("site").distinct().select(F.concat("site", F.lit("/")).alias("url"), F.concat("site", F.lit("/")).alias("final_url"))
    goal = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderkey") % 5 == 0, F.concat("site", F.lit("/o/moved"))).otherwise(at(F.col("o_orderkey")))
    pages = rows.select(at(F.col("o_orderkey")).alias("url"), goal.alias("final_url")).unionByName(home)
    child = rows.select("site", F.floor(F.col("k") / 3).alias("parent"), (F.col("k") % 3).cast("int").alias("ordinal"), at(F.col("o_orderkey")).alias("target"))
    up = rows.select("site", F.col("k").alias("parent"), at(F.col("o_orderkey")).alias("url"))
    links = child.join(up, ["site", "parent"]).select("url", "target", "ordinal").unionByName(child.where("parent = 0").select(F.concat("site", F.lit("/")).alias("url"), "target", "ordinal"))
    return rows.select(F.col("site").alias("origin"), F.lit(ORDER_ROBOTS).alias("body")).distinct(), pages, links


def order_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl for each customer's site, four waves deep, with blocked, failed and redirected pages and budgets that run out."""
    robots, pages, links = _order_site(spark, sf_dir)
    targets = robots.select(F.concat("origin", F.lit("/?utm_source=x")).alias("url"))
    return frontier.crawl_sites(targets, pages, links, frontier.robots_table(robots), max_pages=9, max_depth=3).records


def order_crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sites through discovery: robots.txt and a sitemap are stored responses, some of which failed."""
    robots, pages, links = _order_site(spark, sf_dir)
    number = F.regexp_extract("origin", "c(\\d+)", 1).cast("long")
    body = F.when(number % 4 == 0, F.lit(None)).otherwise(F.col("body"))
    found = robots.select(F.concat("origin", F.lit("/robots.txt")).alias("resource_url"), F.when(number % 4 == 0, 503).otherwise(200).alias("status"), body.alias("body"))
    maps = pages.where("url like '%3'").groupBy(U.origin(F.col("url")).alias("origin")).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    maps = maps.select(F.concat("origin", F.lit("/sitemap.xml")).alias("resource_url"), F.lit(200).alias("status"), F.concat(F.lit("<urlset><url><loc>"), F.array_join("urls", "</loc></url><url><loc> "), F.lit("</loc></url></urlset>")).alias("body"))
    targets = robots.select(F.concat("origin", F.lit("/")).alias("url"))
    sites = frontier.crawl_projects(found.unionByName(maps), targets, pages, links, max_pages=9, max_depth=1).sites
    return sites.select("site", "status", "truncated", "analyzed_pages", "blocked_pages", "skipped_pages", "error_pages", "failed_resources", F.col("limitation").isNotNull().alias("limited"))


QUERIES = {f.__name__: f for f in (host_crawls, order_crawls, order_crawl_status)}


def _crawl_sql(inputs: str, most: int, depth: int) -> str:
    """``rec`` (records) and ``cut`` (sites with URLs left), wave by wave, over ``targets, pgs, links, rules, maps``."""
    steps = [
        "final AS (SELECT url, min(final_url) AS f FROM pgs GROUP BY url)",
        f"""w0 AS (SELECT * FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY kind, url) AS n, CASE WHEN kind = 1 THEN 'sitemap' END AS discovered_from, 0 AS used
 FROM (SELECT site, min(url) AS url, 0 AS kind FROM targets GROUP BY site UNION ALL SELECT DISTINCT site, url, 1 FROM maps WHERE site IN (SELECT site FROM targets))) WHERE n <= {most + 1})""",
    ]
    for d in range(depth + 1):
        steps.append(f"""t{d} AS (SELECT w.*, f.f AS final_url, coalesce(b.ok, true) AS fits FROM w{d} w LEFT JOIN final f ON f.url = w.url
 LEFT JOIN (SELECT w.site, w.url, arg_max(r.ok, 2 * length(r.prefix) + r.ok::INT) AS ok FROM w{d} w JOIN rules r ON r.site = w.site AND starts_with(substr(w.url, length(w.site) + 1), r.prefix) GROUP BY 1, 2) b ON b.site = w.site AND b.url = w.url
 WHERE w.n <= {most} - w.used)""")
        before = " UNION ALL ".join(f"SELECT site, final_url FROM r{k} WHERE outcome = 'analyzed'" for k in range(d)) or "SELECT '' AS site, '' AS final_url"
        steps.append(f"""r{d} AS (SELECT site, used + n - 1 AS ordinal, url, {d} AS depth, discovered_from, CASE WHEN outcome IN ('analyzed', 'skipped') THEN final_url END AS final_url, outcome FROM (SELECT *,
 CASE WHEN NOT fits THEN 'blocked' WHEN final_url IS NULL THEN 'error' WHEN (site, final_url) IN ({before}) OR min(n) FILTER (WHERE fits) OVER (PARTITION BY site, final_url) < n THEN 'skipped' ELSE 'analyzed' END AS outcome FROM t{d}))""")
        if d < depth:
            queued = " UNION ALL ".join(f"SELECT site, url FROM w{k}" for k in range(d + 1))
            steps.append(f"""w{d + 1} AS (SELECT * FROM (SELECT c.site, c.target AS url, row_number() OVER (PARTITION BY c.site ORDER BY c.first.a, c.first.b, c.target) AS n, c.first.u AS discovered_from, u.used
 FROM (SELECT r.site, l.target, min({{'a': r.ordinal, 'b': l.ordinal, 'u': l.url}}) AS first FROM r{d} r JOIN links l ON l.url = r.url WHERE r.outcome = 'analyzed' AND starts_with(l.target, r.site || '/') GROUP BY 1, 2) c
 JOIN (SELECT site, max(ordinal) + 1 AS used FROM r{d} GROUP BY site) u ON u.site = c.site WHERE (c.site, c.target) NOT IN ({queued})) WHERE n <= {most + 1})""")
    rec = " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(depth + 1))
    cut = " UNION ".join(f"SELECT site FROM w{d} WHERE n > {most} - used" for d in range(depth + 1))
    return f"WITH {inputs}, {', '.join(steps)}, rec AS ({rec}), cut AS ({cut})"


_RECORDS = " SELECT site, ordinal, url, depth, discovered_from, outcome, final_url FROM rec"
_PLAIN = "lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+')) || regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]+', ''), '#.*$', ''), '[?]utm_[a-z]+=[^&]*$', '')"
_HOST_INPUTS = f"""own AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/]+') AS site, html FROM (SELECT {_PLAIN} AS url, html FROM pages)),
targets AS (SELECT site, url FROM own), maps AS (SELECT site, url FROM own), pgs AS (SELECT url, url AS final_url FROM own),
links AS (SELECT url, site || replace(replace(url_encode(replace(hs[i], '&amp;', '&')), '%2F', '/'), '%2C', ',') AS target, i - 1 AS ordinal
 FROM (SELECT url, site, hs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT url, site, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs FROM own))),
rules AS (SELECT DISTINCT site, r.prefix, r.ok FROM own CROSS JOIN (VALUES ('/the', false), ('/the/open', true), ('/and?', false)) r(prefix, ok))"""
_ORDER_INPUTS = """placed AS (SELECT 'https://c' || o_custkey || '.example' AS site, o_orderkey AS key, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
targets AS (SELECT DISTINCT site, site || '/' AS url FROM placed),
pgs AS (SELECT site || '/o/' || key AS url, CASE WHEN st = 'P' THEN NULL WHEN key % 5 = 0 THEN site || '/o/moved' ELSE site || '/o/' || key END AS final_url FROM placed UNION ALL SELECT url, url FROM targets),
links AS (SELECT CASE WHEN c.k < 3 THEN c.site || '/' ELSE p.site || '/o/' || p.key END AS url, c.site || '/o/' || c.key AS target, c.k % 3 AS ordinal FROM placed c LEFT JOIN placed p ON p.site = c.site AND p.k = c.k // 3),
"""
ORACLE_SQL = {
    "host_crawls": _crawl_sql(_HOST_INPUTS, 12, 2) + _RECORDS,
    "order_crawls": _crawl_sql(_ORDER_INPUTS + "maps AS (SELECT site, url FROM targets WHERE false), rules AS (SELECT site, r.prefix, r.ok FROM targets CROSS JOIN (VALUES ('/o/1', false), ('/o/12', true)) r(prefix, ok))", 9, 3) + _RECORDS,
    "order_crawl_status": _crawl_sql(_ORDER_INPUTS + """maps AS (SELECT site, site || '/o/' || key AS url FROM placed WHERE key % 10 = 3), failing AS (SELECT site, regexp_extract(site, 'c([0-9]+)', 1)::BIGINT % 4 = 0 AS bad FROM targets),
rules AS (SELECT t.site, r.prefix, r.ok FROM failing t CROSS JOIN (VALUES ('/o/1', false), ('/o/12', true)) r(prefix, ok) WHERE NOT t.bad)""", 9, 1)
    + """ SELECT s.*, CASE WHEN truncated OR blocked_pages + skipped_pages + error_pages > 0 THEN 'partial' ELSE 'complete' END AS status, f.bad::BIGINT AS failed_resources, f.bad AS limited
FROM (SELECT site, site IN (SELECT site FROM cut) AS truncated, count(*) FILTER (WHERE outcome = 'analyzed') AS analyzed_pages, count(*) FILTER (WHERE outcome = 'blocked') AS blocked_pages,
 count(*) FILTER (WHERE outcome = 'skipped') AS skipped_pages, count(*) FILTER (WHERE outcome = 'error') AS error_pages FROM rec GROUP BY site) s JOIN failing f USING (site)""",
}
