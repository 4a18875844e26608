"""Breadth-first crawls of any number of sites at once, over tables of pages and links.

All sites' queues are one table. A wave is one depth: its rows are ranked within their site, cut to the site's budget,
judged (robots, retrieval, final URL seen before), and joined with the links of what was analysed for the next wave. URLs
queued before are left out by an anti-join. So a crawl takes ``max_depth + 1`` waves however many sites and pages there
are, each with joins on urls and windows of at most ``max_pages + 1`` rows a site (rows beyond never reach the shuffle), and no
list of URLs stands on the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import urls as U
from evidentia.operators import discovery
from evidentia.sources.scratch import settled

MOST_PAGES, MOST_DEPTH = 50, 5


class Crawls(NamedTuple):
    """``records``: ``site, ordinal, url, depth, discovered_from, outcome, final_url``; ``sites``: ``site, status, truncated`` and a count for each outcome."""

    records: DataFrame
    sites: DataFrame


def robots_table(robots: DataFrame) -> DataFrame:
    """``origin, prefix, allow`` of robots texts (``origin, body``): rules below a User-agent line of ``*``, comments cut, empty values left out."""
    parts = lambda line: F.split(F.regexp_replace(line, "#.*$", ""), ":", 2)
    name = lambda line: F.lower(F.btrim(parts(line)[0]))
    value = lambda line: F.btrim(F.coalesce(F.get(parts(line), F.lit(1)), F.lit("")))
    lines = F.transform(F.split("body", "\\r\\n|\\r|\\n"), lambda x: F.struct(name(x).alias("name"), value(x).alias("value")))
    rows = robots.select("origin", F.filter(lines, lambda x: x["name"].isin("user-agent", "allow", "disallow")).alias("lines"))
    # The group of a line is its nearest User-agent line before it.
    agent = F.aggregate(
        "lines", F.struct(F.lit(False).alias("ours"), F.array().cast("array<struct<prefix:string,allow:boolean>>").alias("rules")),
        lambda s, x: F.struct(
            F.when(x["name"] == "user-agent", x["value"] == "*").otherwise(s["ours"]).alias("ours"),
            F.when((x["name"] != "user-agent") & s["ours"] & (x["value"] != ""), F.concat(s["rules"], F.array(F.struct(x["value"].alias("prefix"), (x["name"] == "allow").alias("allow"))))).otherwise(s["rules"]).alias("rules"),
        ),
    )
    return rows.select("origin", F.explode(agent["rules"]).alias("r")).select("origin", "r.prefix", "r.allow")


def _ranked(rows: DataFrame, order: list[Column], most: int, name: str = "n") -> DataFrame:
    """The first ``most`` rows of each site, numbered from 1; the limit is a constant, so it applies before the shuffle too."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col(name) <= most)


def _fits(wave: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``wave`` with ``fits``: the longest prefix wins, allow wins ties, no match allows."""
    if rules is None:
        return wave.withColumn("fits", F.lit(True))
    hits = wave.select("site", "url", U.path_and_query(F.col("url")).alias("path")).distinct().join(rules.withColumnRenamed("origin", "site"), "site").where(F.col("path").startswith(F.col("prefix")))
    best = hits.groupBy("site", "url").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("best"))
    return wave.join(best, ["site", "url"], "left").withColumn("fits", F.coalesce("best.allow", F.lit(True))).drop("best")


def crawl_sites(targets: DataFrame, pages: DataFrame, links: DataFrame, rules: DataFrame | None = None, sitemaps: DataFrame | None = None, max_pages: int = 10, max_depth: int = 2) -> Crawls:
    """One crawl for each site (origin) of ``targets`` (``url``; a site with several starts at the smallest).

    ``pages`` maps ``url`` to ``final_url`` (null, or no row: the page fails; several rows: the smallest), ``links`` has ``url, target, ordinal``, all
    canonical (links of one place, as of a page that was read twice, go by target); ``rules`` is ``robots_table``'s, ``sitemaps`` has ``origin, url``. Seeds are the target, then the site's sitemap URLs in order, which
    are not compared with the target. Blocked, skipped and failed records use up ``max_pages`` too; a crawl is
    ``partial`` where some record isn't ``analyzed`` or URLs were left in its queue. Null and non-http urls give no site; no targets, no rows.
    """
    if not (1 <= max_pages <= MOST_PAGES and 0 <= max_depth <= MOST_DEPTH):
        raise ValueError("crawl bounds are out of range")
    starts = targets.select(U.canonical(F.col("url")).alias("url")).withColumn("site", U.origin(F.col("url"))).where("site <> ''")
    queue = starts.groupBy("site").agg(F.min("url").alias("url")).select("site", "url", F.lit(0).alias("kind"))
    if sitemaps is not None:
        listed = sitemaps.select(F.lower("origin").alias("site"), U.canonical(F.col("url")).alias("url")).where(U.origin(F.col("url")) == F.col("site")).distinct()
        queue = queue.unionByName(listed.join(queue.select("site"), "site", "left_semi").withColumn("kind", F.lit(1)))
    final = pages.where("url is not null").groupBy("url").agg(F.min("final_url").alias("final_url"))
    edges = links.where("target is not null").select(F.col("url").alias("parent_url"), "target", F.col("ordinal").alias("link"))
    from_sitemap = F.when(F.col("kind") == 1, F.lit("sitemap"))
    wave = _ranked(queue, [F.col("kind"), F.col("url")], max_pages + 1).select("site", "url", "n", from_sitemap.alias("discovered_from"), F.lit(0).alias("used"))
    wave, seen, records, cut = settled(wave), None, None, None
    for depth in range(max_depth + 1):
        left = wave.where(F.col("n") > max_pages - F.col("used")).select("site")
        cut = left if cut is None else cut.unionByName(left)
        taken = _fits(wave.where(F.col("n") <= max_pages - F.col("used")), rules).join(final, "url", "left")
        if records is None:
            fresh = taken.withColumn("again", F.lit(False))
        else:
            before = records.where("outcome = 'analyzed'").select("site", "final_url", F.lit(True).alias("again"))
            fresh = taken.join(before, ["site", "final_url"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
        ready = F.col("fits") & F.col("final_url").isNotNull()
        now = settled(_judge(fresh, ready).select("site", (F.col("used") + F.col("n") - 1).alias("ordinal"), "url", F.lit(depth).alias("depth"), "discovered_from", "outcome", F.when(F.col("outcome").isin("analyzed", "skipped"), F.col("final_url")).alias("final_url")))
        records = now if records is None else records.unionByName(now)
        if depth == max_depth:
            break
        queued = wave.select("site", F.col("url").alias("target"))
        seen = queued if seen is None else seen.unionByName(queued)
        parents = now.where("outcome = 'analyzed'").select("site", F.col("url").alias("parent_url"), F.col("ordinal").alias("parent"))
        found = parents.join(edges, "parent_url").where(F.col("target").startswith(F.concat("site", F.lit("/"))))
        found = found.groupBy("site", "target").agg(F.min(F.struct("parent", "link", "parent_url")).alias("first")).join(seen, ["site", "target"], "left_anti")
        used = now.groupBy("site").agg((F.max("ordinal") + 1).alias("used"))
        nxt = _ranked(found, [F.col("first"), F.col("target")], max_pages + 1).join(used, "site")
        wave = settled(nxt.select("site", F.col("target").alias("url"), "n", F.col("first.parent_url").alias("discovered_from"), "used"))
        if wave.isEmpty():
            break
    truncated = cut.distinct().withColumn("truncated", F.lit(True))
    count = lambda o: F.count_if(F.col("outcome") == o).alias(f"{o}_pages")
    sites = records.groupBy("site").agg(*[count(o) for o in ("analyzed", "blocked", "skipped", "error")]).join(truncated, "site", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    partial = F.col("truncated") | (F.col("blocked_pages") + F.col("skipped_pages") + F.col("error_pages") > 0)
    return Crawls(records, sites.withColumn("status", F.when(partial, "partial").otherwise("complete")))


def _judge(rows: DataFrame, ready: Column) -> DataFrame:
    """``outcome`` of a wave's rows: of those with one final URL the first is analysed, if no earlier wave did."""
    first = rows.where(ready).groupBy("site", "final_url").agg(F.min("n").alias("first"))
    kinds = F.when(~F.col("fits"), "blocked").when(F.col("final_url").isNull(), "error").when(F.col("again") | (F.col("first") < F.col("n")), "skipped").otherwise("analyzed")
    return rows.join(first, ["site", "final_url"], "left").withColumn("outcome", kinds)


def crawl_projects(resources: DataFrame, targets: DataFrame, pages: DataFrame, links: DataFrame, max_pages: int = 10, max_depth: int = 2) -> Crawls:
    """Discovery, then the crawl: ``resources`` (``resource_url, status, body``) holds robots.txt and sitemap responses.

    ``sites`` also has ``failed_resources`` (responses that aren't 2xx, or have no body) and ``limitation``, which says so where there are any.
    Sitemaps are the declared and the conventional ones that answered.
    """
    place = resources.select(F.lower(U.origin(F.col("resource_url"))).alias("origin"), F.lower(U.path_and_query(F.col("resource_url"))).alias("path"), F.col("resource_url").alias("sitemap_url"), "body", (F.coalesce(F.col("status").between(200, 299), F.lit(False)) & F.col("body").isNotNull()).alias("ok"))
    robots = place.where("ok and path = '/robots.txt'").select("origin", "body")
    declared = discovery.declared_sitemaps(targets.select(U.origin(U.canonical(F.col("url"))).alias("origin")).distinct().join(robots, "origin", "left").select("origin", F.coalesce("body", F.lit("")).alias("body")))
    maps = declared.join(place.where("ok").select("sitemap_url", "body"), "sitemap_url").select("origin", "body")
    out = crawl_sites(targets, pages, links, robots_table(robots), discovery.sitemap_urls(maps), max_pages, max_depth)
    failed = place.where("not ok").groupBy(F.col("origin").alias("site")).agg(F.count("*").alias("failed_resources"))
    sites = out.sites.join(failed, "site", "left").withColumn("failed_resources", F.coalesce("failed_resources", F.lit(0)))
    said = F.when(F.col("failed_resources") > 0, F.concat(F.col("failed_resources").cast("string"), F.lit(" discovery resource(s) could not be read; the crawl went on by links alone.")))
    return Crawls(out.records, sites.withColumn("limitation", said))
