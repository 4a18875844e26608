"""Spans, selectors and raw records: over the texts of documents, over HTML that Spark makes of their lines, and over the raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.html import parse_pages
from evidentia.operators import coverage, evidence, page_analysis
from evidentia.plans.page_queries import _TITLE, ended


def contact_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address and telephone number of the texts, with what stands around it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = lambda kind, pattern: F.transform(coverage.spans(F.col("text"), pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["text"].alias("term"), coverage.snippet(F.col("text"), m["start"], F.length(m["text"])).alias("snippet")))
    return docs.select("doc_id", F.inline(F.concat(found("email", coverage.EMAIL), found("phone", coverage.PHONE))))


def _lined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: by place, its lines become headings, images with and without alternative texts, and JSON-LD blocks, most of them faulty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n")))
    say = lambda x: F.concat(F.lit("line "), x["i"].cast("string"))
    element = lambda x: (
        F.when(x["i"] % 6 == 0, F.concat(F.lit("<h2>"), say(x), F.lit("</h2>"))).when(x["i"] % 6 == 1, F.concat(F.lit("<h3> "), say(x), F.lit("\n</h3>"))).when(x["i"] % 6 == 2, F.concat(F.lit('<img src="/p'), x["n"].cast("string"), F.lit('.png">')))
        .when(x["i"] % 6 == 3, F.concat(F.lit('<img src="/q.png" alt="'), F.when(x["n"] % 2 == 0, "  ").otherwise("a  b"), F.lit('">')))
        .when(x["i"] % 6 == 4, F.concat(F.lit('<script type="application/ld+json">'), F.when(x["n"] % 3 == 0, '{"@type": "Thing"}').when(x["n"] % 3 == 1, F.concat(F.lit("["), F.repeat(F.lit("\n"), (x["n"] % 5).cast("int")), F.lit("x]"))).otherwise(" "), F.lit("</script>")))
        .otherwise(F.concat(F.lit("<div><h2>"), say(x), F.lit("</h2></div>")))
    )
    return docs.select("page_id", F.concat(F.lit("https://d.example/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("<html><body>"), F.array_join(F.transform(lines, element), ""), F.lit("</body></html>")).alias("html"))


def element_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, images and faulty blocks of each made page with the selectors of single elements."""
    p = parse_pages(_lined_pages(spark, sf_dir))
    issue = lambda x: F.when(x["alt"].isNull(), "missing").when(F.btrim(x["alt"]) == "", "empty").otherwise("none")
    joined = lambda xs: F.array_join(xs, "|")
    return p.select(
        "page_id", joined(F.transform("headings", lambda h: F.concat_ws("=", h["selector"], h["text"]))).alias("headings"), joined(F.transform("images", lambda x: F.concat_ws("=", x["selector"], issue(x)))).alias("images"),
        joined(F.transform(F.filter("json_ld", lambda b: ~b["valid"]), lambda b: F.concat_ws("=", b["selector"], b["error"]))).alias("errors"),
    )


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 raw records of the regular pages, those that SQL can read off the HTML with their values."""
    pages = parse_pages(ended(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    rows = evidence.raw_records(page_analysis.analyze(pages))
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("observed_value")))
    heads = F.from_json(value("headingHierarchy"), "array<struct<level:int,text:string,selector:string>>")
    canonical = F.get_json_object(value("canonicalStatus"), "$.status")
    return rows.groupBy("page_id").agg(
        F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_list("ordinal")), ",").alias("ordinals"), F.count("selector").alias("selectors"), value("statusCode").alias("status_code"), value("finalUrl").alias("final_url"), value("title").alias("title"),
        value("documentLanguage").alias("language"), value("viewportPresent").alias("viewport"), canonical.alias("canonical"), F.array_join(F.transform(heads, lambda h: F.concat_ws("=", h["selector"], h["level"].cast("string"), h["text"])), "|").alias("headings"),
        value("schemaTypes").alias("schema_types"), F.get_json_object(value("images"), "$.imageCount").alias("images"),
    )


QUERIES = {f.__name__: f for f in (contact_snippets, element_records, page_records)}


def _spans(kind: str, pattern: str) -> str:
    """Matches are fenced by a mark; places are sums of the pieces before."""
    return f"""SELECT doc_id, '{kind}' AS kind, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(p) AS start, p AS term, i
 FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents))"""


_EMAIL, _PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\+?[0-9][0-9\\s().-]{7,}[0-9]"
_HEAD = _TITLE.replace("<title>([^<]*)</title>", "<h1>([^<]*)</h1>")
ORACLE_SQL = {
    "contact_snippets": f"""WITH s AS (SELECT * FROM ({_spans('email', _EMAIL)} UNION ALL {_spans('phone', _PHONE)}) WHERE i % 2 = 0)
SELECT doc_id, kind, start::INT AS start, term, trim(regexp_replace(substr(text, greatest(0, start - 45)::BIGINT + 1, (start + length(term) + 45 - greatest(0, start - 45))::BIGINT), '\\s+', ' ', 'g')) AS snippet FROM s JOIN documents USING (doc_id)""",
    "element_records": """WITH l AS (SELECT doc_id AS page_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
e AS (SELECT page_id, i, length(x) AS n, i % 6 AS m, count(*) FILTER (i % 6 = 4) OVER w AS block, count(*) FILTER (i % 6 IN (2, 3)) OVER w AS image FROM l WINDOW w AS (PARTITION BY page_id ORDER BY i))
SELECT page_id, coalesce(string_agg(CASE m WHEN 0 THEN 'h2:nth-of-type(' || (i // 6 + 1) || ')' WHEN 1 THEN 'h3:nth-of-type(' || (i // 6 + 1) || ')' ELSE 'h2:nth-of-type(1)' END || '=line ' || i, '|' ORDER BY i) FILTER (m IN (0, 1, 5)), '') AS headings,
 coalesce(string_agg('img:nth-of-type(' || image || ')=' || CASE WHEN m = 2 THEN 'missing' WHEN n % 2 = 0 THEN 'empty' ELSE 'none' END, '|' ORDER BY i) FILTER (m IN (2, 3)), '') AS images,
 coalesce(string_agg('script[type="application/ld+json"]:nth-of-type(' || block || ')=' || CASE WHEN n % 3 = 2 THEN 'the block is empty' ELSE 'Expecting value at line ' || (n % 5 + 1) || ', column ' || CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END END, '|' ORDER BY i) FILTER (m = 4 AND n % 3 > 0), '') AS errors FROM e GROUP BY 1""",
    "page_records": f"""SELECT page_id, 25::BIGINT AS records, '0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24' AS ordinals, 12::BIGINT AS selectors, '200' AS status_code, url AS final_url, nullif({_TITLE}, '') AS title,
 nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS language, CASE WHEN html LIKE '%name="viewport"%' THEN 'true' ELSE 'false' END AS viewport, CASE WHEN html LIKE '%rel="canonical"%' THEN NULL ELSE 'missing' END AS canonical,
 concat_ws('=', 'h1:nth-of-type(1)', '1', {_HEAD}) AS headings, '[]' AS schema_types, len(regexp_extract_all(html, '<img'))::VARCHAR AS images FROM pages""",
}
