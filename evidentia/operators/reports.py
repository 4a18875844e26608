"""Report tables: sections as rows, safe CSV cells, Markdown lines and JSON documents, evidence for citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.facts import is_formula


def csv_cell(x: Column) -> Column:
    """Quoted, quotes doubled; a cell that a spreadsheet would run as formula gets an apostrophe."""
    t = F.coalesce(x.cast("string"), F.lit(""))
    safe = F.when(is_formula(t), F.concat(F.lit("'"), t)).otherwise(t)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def markdown_cell(x: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[\\r\\n]+", " "), F.lit("|"), F.lit("\\|"))


def sections(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The parts as one table of ``section, ordinal`` and text columns, in the given order."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        row = df.select(F.lit(i).alias("ordinal"), F.lit(name).alias("section"), *[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        out = row if out is None else out.unionByName(row)
    return out


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c for c in ("ordinal",) if c in rows.columns], F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def markdown_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c for c in ("ordinal",) if c in rows.columns], F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


def json_documents(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"}).alias("document"))


def evidence_items(findings: DataFrame, run: str = "page_id") -> DataFrame:
    """Findings as citable items with ids that don't depend on order."""
    return findings.select(F.concat_ws(":", F.lit("finding"), F.col(run).cast("string"), "rule_id", "field").alias("evidence_id"), "url", "rule_id", "field", "observed_value")


def ungrounded(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that no supplied evidence has; an interpretation with any is refused."""
    return cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def chosen(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """``rows`` where each given column has the given value (category, priority, status, project_id ...); None or "all" asks for nothing."""
    for column, value in wanted.items():
        if value not in (None, "", "all"):
            rows = rows.where(F.col(column) == value)
    return rows


def metric_cards(metrics: DataFrame) -> DataFrame:
    """One row: records, distinct projects and imports, clicks and impressions; zeros for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return metrics.agg(F.count("*").alias("records"), F.count_distinct("project_id").alias("projects"), F.count_distinct("import_id").alias("imports"), total("clicks"), total("impressions"))


def opportunity_cards(opportunities: DataFrame) -> DataFrame:
    """One row: opportunities, those of high priority, and new ones."""
    return opportunities.agg(F.count("*").alias("opportunities"), F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("status") == "new").alias("new"))


def inventory(found: DataFrame, sites: DataFrame, key: str = "site_key") -> DataFrame:
    """``key, input_order, findings``: the number of findings of each site of a report, sites without any included."""
    n = found.groupBy(key).agg(F.count("*").alias("findings"))
    return sites.select(key, "input_order").join(n, key, "left").fillna(0, ["findings"])
