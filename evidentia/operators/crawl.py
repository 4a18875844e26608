"""Robots rules, the bounded crawl of one site, and crawl rollups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import urls as U
from evidentia.operators import frontier


def robots_rules(text: str) -> list[tuple[str, bool]]:
    """(path prefix, allowed) of groups whose latest User-agent line is ``*``; comments and empty values don't count."""
    out, ours = [], False
    for line in text.splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            ours = value == "*"
        elif ours and name in ("allow", "disallow") and value:
            out.append((value, name == "allow"))
    return out


def allowed(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Longest matching prefix wins, allow wins ties, no match allows: one expression over a site's rules."""
    best = F.greatest(F.lit(-1), *[F.when(path.startswith(p), F.lit(2 * len(p) + int(ok))).otherwise(F.lit(-1)) for p, ok in rules]) if rules else F.lit(-1)
    return (best == -1) | (F.pmod(best, F.lit(2)) == 1)


def robots_join(urls: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """``key, allowed`` for many sites: ``rules`` has ``origin, prefix, allow``. The join is on the origin; the prefix test
    and the choice of the longest rule are aggregated, so no rule list is gathered."""
    paths = urls.select(key, U.origin(F.col(key)).alias("origin"), U.path_and_query(F.col(key)).alias("path"))
    hits = paths.join(rules, "origin").where(F.col("path").startswith(F.col("prefix")))
    best = hits.groupBy(key).agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("b"))
    return paths.select(key).distinct().join(best, key, "left").select(key, F.coalesce("b.allow", F.lit(True)).alias("allowed"))


class CrawlResult(NamedTuple):
    pages: DataFrame
    status: str
    truncated: bool


def crawl(spark: SparkSession, target: str, pages: DataFrame, links: DataFrame, robots: str = "", sitemap: tuple[str, ...] = (), max_pages: int = 10, max_depth: int = 2) -> CrawlResult:
    """Breadth-first records of one site, ``ordinal, url, depth, outcome``: ``frontier.crawl_sites`` for one target, whose
    robots text and sitemap URLs are given."""
    start = U.canonical_py(target)
    home = U.canonical_py(start).split("/", 3)[:3]
    listed = {u for u in (U.canonical_py(u, start) for u in sitemap) if u.split("/", 3)[:3] == home}
    origin = "/".join(home)
    rules = spark.createDataFrame([(origin, p, ok) for p, ok in robots_rules(robots)], "origin string, prefix string, allow boolean")
    maps = spark.createDataFrame([(origin, u) for u in listed], "origin string, url string")
    found = frontier.crawl_sites(spark.createDataFrame([(start,)], "url string"), pages, links, rules, maps, max_pages, max_depth)
    outcome = F.when(F.col("outcome") == "skipped", "skipped-redirect-duplicate").otherwise(F.col("outcome"))
    said = found.sites.first()
    return CrawlResult(found.records.select("ordinal", "url", "depth", outcome.alias("outcome")), said["status"], said["truncated"])


def aggregate(records: DataFrame, analyses: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for the crawl: records by ``outcome``, words, sorted distinct schema types and section terms of the analysed
    pages, and pages by rule (a rule counts once a page; most pages first, then by id). Terms and rules are distinct before
    they meet, so the row grows with their variety and not with the pages; nothing analysed gives zeros and empty lists."""
    said = lambda kind, **xs: F.struct(*[xs.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("outcome", "string"), ("n", "long"), ("type", "string"), ("term", "string"), ("rule_id", "string"))], F.lit(kind).alias("kind"))
    parts = [
        records.groupBy("outcome").agg(F.count("*").alias("n")).select(said("outcome", outcome=F.col("outcome"), n=F.col("n")).alias("s")),
        analyses.agg(F.sum("word_count").alias("n")).select(said("words", n=F.col("n").cast("long")).alias("s")),
        analyses.select(F.explode("schema_types").alias("x")).distinct().select(said("type", type=F.col("x")).alias("s")),
        analyses.select(F.explode("section_terms").alias("x")).distinct().select(said("term", term=F.col("x")).alias("s")),
        found.groupBy("rule_id").agg(F.count_distinct(key).alias("n")).select(said("rule", rule_id=F.col("rule_id"), n=F.col("n")).alias("s")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    kind, n = F.col("s.kind"), F.col("s.n")
    count = lambda outcome: F.coalesce(F.sum(F.when((kind == "outcome") & (F.col("s.outcome") == outcome), n)), F.lit(0)).alias(f"{outcome}_pages")
    rules = F.array_sort(F.collect_list(F.when(kind == "rule", F.struct((-n).alias("less"), F.col("s.rule_id").alias("rule_id")))))
    return every.agg(
        *[count(x) for x in ("analyzed", "blocked", "skipped", "error")], F.coalesce(F.sum(F.when(kind == "words", n)), F.lit(0)).alias("total_words"),
        F.array_sort(F.collect_list("s.type")).alias("schema_types"), F.array_sort(F.collect_list("s.term")).alias("section_terms"),
        F.transform(rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), (-r["less"]).alias("pages"))).alias("finding_counts"),
    )


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
