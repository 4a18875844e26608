"""Site resources over stored responses: availability of robots.txt and sitemap.xml, and sitemap locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U

# XML's named references.
XML = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def with_resources(pages: DataFrame, resources: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with availability and status of both root resources; ``resources`` has ``resource_url, status``.

    A 2xx status is available; a resource without a response is unavailable with a null status.
    """
    by = resources.select(F.lower(U.origin(F.col("resource_url"))).alias("_o"), F.lower(U.path_and_query(F.col("resource_url"))).alias("_p"), "status")
    wide = by.groupBy("_o").agg(
        F.max(F.when(F.col("_p") == "/robots.txt", F.col("status"))).alias("robots_txt_status_code"), F.max(F.when(F.col("_p") == "/sitemap.xml", F.col("status"))).alias("sitemap_xml_status_code")
    )
    ok = lambda c: F.coalesce(F.col(c).between(200, 299), F.lit(False))
    out = pages.withColumn("_o", U.origin(F.col(url))).join(wide, "_o", "left").drop("_o")
    return out.withColumns({"robots_txt_available": ok("robots_txt_status_code"), "sitemap_xml_available": ok("sitemap_xml_status_code")})


def declared_sitemaps(robots: DataFrame) -> DataFrame:
    """``origin, sitemap_url``: Sitemap lines of robots texts (``origin, body``) and the conventional place, distinct."""
    lines = robots.select("origin", F.explode(F.regexp_extract_all("body", F.lit("(?im)^\\s*sitemap\\s*:\\s*(\\S+)"), F.lit(1))).alias("sitemap_url"))
    usual = robots.select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"))
    return usual.unionByName(lines).distinct()


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``origin, url``: distinct decoded locations of sitemap documents (``origin, body``)."""
    loc = F.col("loc")
    for name, char in XML.items():
        loc = F.regexp_replace(loc, f"(?i)&{name};", char)
    found = sitemaps.select("origin", F.explode(F.regexp_extract_all("body", F.lit("(?is)<loc\\b[^>]*>(.*?)</loc>"), F.lit(1))).alias("loc"))
    return found.select("origin", T.collapse(loc).alias("url")).where("url <> ''").distinct()
