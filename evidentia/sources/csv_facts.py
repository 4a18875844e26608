"""CSV exports as DataFrames of strings: the file gate, quoted parsing, row numbers and whole-file errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from evidentia.operators.facts import CONNECTORS, ImportError_, check_headers, suggest_mapping

MIME_TYPES = ("text/csv", "application/csv", "application/vnd.ms-excel", "text/plain")
MOST_COLUMNS, MOST_CHARS, MOST_UPLOAD = 100, 10_000, 2 * 1024 * 1024


def gate(file_name: str, mime_type: str, size: int | None = None) -> None:
    """Refuses what isn't an uploaded CSV file: its name, type and, where given, size in bytes (2 MiB at most)."""
    if not file_name.strip().lower().endswith(".csv") or mime_type.strip().lower() not in MIME_TYPES:
        raise ImportError_("a .csv file of a CSV type is needed")
    if size is not None and size > MOST_UPLOAD:
        raise ImportError_(f"an uploaded file may have {MOST_UPLOAD} bytes")


def header_of(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("multiLine", True).option("escape", '"').option("quote", '"').csv(path).limit(1).collect()
    if not first:
        raise ImportError_("the file is empty")
    return [(x or "").replace("﻿", "").strip() for x in first[0]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one file: trimmed strings by header, and ``row_number`` from 1 in the file's order.

    No row or size ceiling applies here (``gate`` has that of uploads); a row with more or fewer cells than the header, or a quote left
    open, fails the whole file. Rows whose cells are all empty are dropped.
    """
    if spark.read.text(path).where(F.col("value").rlike("\\x00")).limit(1).count():
        raise ImportError_("null bytes aren't allowed")  # the CSV reader drops them unseen
    headers = header_of(spark, path)
    check_headers(headers)
    if len(headers) > MOST_COLUMNS:
        raise ImportError_("too many columns")
    schema = S.StructType([*[S.StructField(h, S.StringType()) for h in headers], S.StructField("_bad", S.StringType())])
    rows = (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path)
    )
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).select("*", F.col("_bad").isNotNull().alias("_ragged")).cache()
    if rows.where("_ragged").limit(1).count():
        raise ImportError_("a row doesn't have the header's cells, or a quote is left open")
    cells = [F.btrim(F.col(f"`{h}`")) for h in headers]
    if rows.where(F.greatest(F.lit(0), *[F.coalesce(F.length(c), F.lit(0)) for c in cells]) > MOST_CHARS).limit(1).count():
        raise ImportError_("a cell is too long")
    full = rows.where(F.concat(*[F.coalesce(c, F.lit("")) for c in cells]) != "")
    # One multi-line file is one partition in Spark, so its order is that of the file.
    number = F.row_number().over(Window.orderBy("_at"))
    return full.select(*[c.alias(h) for c, h in zip(cells, headers, strict=True)], number.alias("row_number"))


def preview(spark: SparkSession, path: str, connector: str, mime_type: str = "text/csv") -> dict:
    """What an upload holds: hash, headers, five rows, number of rows, suggested mapping, warnings of required fields without a header."""
    if connector not in CONNECTORS:
        raise ImportError_("unknown connector")
    file = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= MOST_UPLOAD, F.sha2("content", 256)).alias("sha256")).first()
    gate(file["path"], mime_type, file["length"])
    rows = read(spark, path)
    headers = [c for c in rows.columns if c != "row_number"]
    mapping = suggest_mapping(headers, connector)
    missing = [f for f in CONNECTORS[connector][1] if f not in mapping]
    warnings = [f"Map required field(s): {', '.join(missing)}."] if missing else []
    sample = [r.asDict() for r in rows.where("row_number <= 5").orderBy("row_number").collect()]
    return {"sha256": file["sha256"], "headers": headers, "sample": sample, "rows": rows.count(), "mapping": mapping, "connector": connector, "warnings": warnings}
