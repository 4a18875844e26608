"""Whole reports as ordered lines: research and growth reports of any number of runs, as CSV and Markdown.

A line carries its place: section, then the keys of its row. Lines are sorted by ranges and numbered by offsets (the number of lines of
each range is counted once), so no task sorts or holds a whole report; files are written range by range, in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import compare
from evidentia.operators.reports import csv_cell, markdown_cell
from evidentia.sources.scratch import settled

RESEARCH = ("section", "site", "rule_or_field", "value", "source_url", "limitation")
GROWTH = ("record_type", "project_id", "record_id", "metric_type_or_rule", "date", "page", "query", "observation_or_value", "calculation", "status", "limitation")
#: What each kind of record doesn't say.
LIMITS = {
    "comparison-metric": "A difference between public pages, not a prediction.", "finding": "Read off one response; scripts aren't run.", "comparison-gap": "A difference between public pages, not a prediction.",
    "manual-visibility": "Entered by hand; no cause is inferred.", "metric": "As imported; the file itself isn't kept.", "opportunity": "A rule with fixed thresholds, not a forecast.",
}
_PLACE = ["report", "section", "a", "b", "c"]


def numbered(lines: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """``lines`` with ``number`` from 0 in the given order (within each ``within``, which leads the order).

    The sorted ranges are written with each row's place in its range; a range's first number is the sum of the sizes before
    it, a window over one row a range. Ties share no order, so ``order`` should name a row.
    """
    keys = [within, *order] if within else order
    place = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = settled(place).withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    by = ["_range", *([within] if within else [])]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    w = Window.partitionBy(*([within] if within else [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return rows.join(before, by).withColumn("number", F.col("_before") + F.col("_row") - F.col("_first")).drop("_at", "_range", "_row", "_first", "_before")


def _cells(*cells: Column | str | None) -> Column:
    return F.array(*[F.lit(c).cast("string") if c is None or isinstance(c, str) else c.cast("string") for c in cells])


def _rows(df: DataFrame, report: Column, section: int, a: Column | None, b: Column | None, c: Column | None, cells: Column) -> DataFrame:
    text = lambda x: (F.lit(None) if x is None else x).cast("string")
    number = lambda x: (F.lit(0) if x is None else x).cast("long")
    return df.select(report.cast("string").alias("report"), F.lit(section).alias("section"), number(a).alias("a"), number(b).alias("b"), F.coalesce(text(c), F.lit("")).alias("c"), cells.alias("cells"))


def research_rows(runs: DataFrame, sites: DataFrame, metrics: DataFrame, findings: DataFrame, conclusions: DataFrame, proposals: DataFrame, visibility: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``report, section, a, b, c, cells`` of the research report of each run: the header, each site's metrics and findings, then gaps, proposals,
    manual observations and sources.

    ``runs``: ``run_id, target_url``; ``sites``: ``run_id, input_order, final_url``; ``metrics``: ``compare.long_metrics``; ``findings``: ``run_id, input_order, rule_id, rule_version,
    problem``; ``proposals``: with ``draft`` and ``review_requirement``; ``visibility``: ``target_url, query, rank, citation, url``; ``sources``: ``source_id, claim, url, notes``. A run
    without rows in a part has no lines of it; null values are empty cells.
    """
    run = F.col("run_id")
    order = F.array_position(F.lit(list(compare.metric_columns())), F.col("metric"))
    shown = F.coalesce("label", F.when(F.col("number") == F.floor("number"), F.floor("number").cast("string")).otherwise(F.col("number").cast("string")))
    named = metrics.join(sites.select("run_id", "input_order", "final_url"), ["run_id", "input_order"])
    told = findings.join(sites.select("run_id", "input_order", "final_url"), ["run_id", "input_order"])
    gaps = conclusions.where("kind = 'gap'").join(runs, "run_id")
    difference = F.concat_ws(" / ", F.floor("target").cast("string"), F.floor("benchmark").cast("string"))
    parts = [
        _rows(runs, run, 0, None, None, None, _cells(*RESEARCH)),
        _rows(named, run, 1, F.col("input_order"), order, None, _cells("comparison-metric", F.col("final_url"), F.col("metric"), shown, F.col("final_url"), LIMITS["comparison-metric"])),
        _rows(told, run, 1, F.col("input_order"), F.lit(1000), F.col("rule_id"), _cells("finding", F.col("final_url"), F.concat_ws("@", "rule_id", "rule_version"), F.col("problem"), F.col("final_url"), LIMITS["finding"])),
        _rows(gaps, run, 2, None, None, F.col("rule_id"), _cells("comparison-gap", F.col("target_url"), F.col("rule_id"), difference, F.col("target_url"), LIMITS["comparison-gap"])),
        _rows(proposals.join(runs, "run_id"), run, 3, None, None, F.col("artifact_id"), _cells("proposal", F.col("target_url"), F.col("artifact_id"), F.col("draft"), F.col("target_url"), F.col("review_requirement"))),
    ]
    if visibility is not None:
        seen = F.concat(F.lit("rank="), F.coalesce(F.col("rank").cast("string"), F.lit("")), F.lit(";citation="), F.coalesce(F.col("citation").cast("string"), F.lit("")))
        parts.append(_rows(visibility.join(runs, "target_url"), run, 4, None, None, F.col("query"), _cells("manual-visibility", F.col("target_url"), F.col("query"), seen, F.col("url"), LIMITS["manual-visibility"])))
    if sources is not None:
        parts.append(_rows(runs.crossJoin(F.broadcast(sources)), run, 5, None, None, F.col("source_id"), _cells("research-source", "", F.col("source_id"), F.col("claim"), F.col("url"), F.col("notes"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def growth_rows(projects: DataFrame, metrics: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``report, section, a, b, c, cells`` of the growth report of each project: the header, its metrics by date and id, its opportunities by id.

    ``metrics`` are stored facts of any kind, ``opportunities`` have ``status`` and ``updated_at`` as text. Cells that a spreadsheet would run are made safe by ``csv_lines``.
    """
    have = set(metrics.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    put = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(col(c).cast("string"), F.lit("not imported")))
    value = (
        F.when(F.col("metric_type") == "search-performance", F.concat_ws("; ", put("clicks", "clicks"), put("impressions", "impressions"), put("ctr", "ctr"), put("averagePosition", "average_position"), put("device", "device"), put("country", "country")))
        .when(F.col("metric_type") == "web-analytics", F.concat_ws("; ", put("sessions", "sessions"), put("users", "users"), put("engagementRate", "engagement_rate"), put("conversions", "conversions")))
        .when(F.col("metric_type") == "campaign-performance", F.concat_ws("; ", put("campaign", "campaign"), put("spend", "spend"), put("clicks", "clicks"), put("conversions", "conversions")))
        .otherwise(F.concat_ws("; ", put("source", "source"), put("leads", "leads"), put("qualifiedLeads", "qualified_leads")))
    )
    date = F.concat_ws(" to ", F.col("date").cast("string"), col("date_to").cast("string"))
    by, asked = F.col("project_id"), F.when(F.col("metric_type") == "search-performance", col("query"))
    said = set(opportunities.columns)
    extra = lambda n: F.col(n) if n in said else None
    days = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    return (
        _rows(projects, by, 0, None, None, None, _cells(*GROWTH))
        .unionByName(_rows(metrics, by, 1, -days, None, F.col("metric_id"), _cells("metric", by, F.col("metric_id"), F.col("metric_type"), date, col("page"), asked, value, None, "accepted", LIMITS["metric"])))
        .unionByName(_rows(opportunities, by, 2, None, None, F.col("opportunity_id"), _cells("opportunity", by, F.col("opportunity_id"), F.col("rule_id"), extra("updated_at"), F.col("page"), F.col("query"), extra("observation"), extra("calculation"), extra("status"), LIMITS["opportunity"])))
    )


def csv_lines(rows: DataFrame, safe: bool = False) -> DataFrame:
    """``report, number, line``: all cells quoted; with ``safe`` those that a spreadsheet would run are marked as text."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.array_join(F.transform("cells", csv_cell if safe else quoted), ",")
    return numbered(rows, _PLACE[1:], "report").select("report", "number", line.alias("line"))


def growth_markdown(projects: DataFrame, counts: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``report, number, line`` of the growth report in Markdown; ``counts``: ``project_id, sources, imports, records, opportunities``, ``projects``: ``project_id, target_url, generated_at``."""
    head = [
        F.concat(F.lit("# Growth report: "), markdown_cell(F.col("target_url"))), F.lit(""), F.concat(F.lit("Generated: "), F.col("generated_at").cast("string")), F.concat(F.lit("Project: "), F.col("project_id").cast("string")), F.lit(""), F.lit("## Imports"), F.lit(""),
        *[F.concat(F.lit(f"- {title}: "), F.coalesce(F.col(c), F.lit(0)).cast("string")) for title, c in (("Sources", "sources"), ("Imports", "imports"), ("Records", "records"), ("Opportunities", "opportunities"))], F.lit(""), F.lit("## Opportunities"), F.lit(""),
    ]
    one = [F.concat(F.lit("### "), F.concat_ws(" - ", F.col("rule_id"), F.col("page"), F.col("query"))), F.lit(""), F.concat(F.lit("- Status: "), F.col("status")), F.concat(F.lit("- Priority: "), F.col("priority")), F.concat(F.lit("- Limitation: "), F.lit(LIMITS["opportunity"])), F.lit("")]
    tail = [F.lit("## Limitations"), F.lit(""), *[F.lit(f"- {LIMITS[k]}") for k in ("metric", "opportunity")], F.lit("")]

    def lines(df: DataFrame, section: int, made: list[Column], key: Column | None = None) -> DataFrame:
        texts = F.array(*[m.cast("string") for m in made])
        return df.select(F.col("project_id").cast("string").alias("report"), F.lit(section).alias("section"), (F.lit("") if key is None else key.cast("string")).alias("c"), F.posexplode(texts).alias("b", "line"))

    every = lines(projects.join(counts, "project_id", "left"), 0, head).unionByName(lines(opportunities, 1, one, F.col("opportunity_id"))).unionByName(lines(projects, 2, tail))
    return numbered(every, ["section", "c", "b"], "report").select("report", "number", "line")


def research_markdown(runs: DataFrame, sites: DataFrame, metrics: DataFrame, conclusions: DataFrame, proposals: DataFrame) -> DataFrame:
    """``report, number, line`` of the research report in Markdown: inventory, matrix, gaps, groups of rules, proposals and limitations.

    ``sites`` has ``run_id, input_order, role, final_url, eligibility, findings``. Parts without rows say so.
    """
    run = F.col("run_id")
    flat = lambda *xs: F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(x) for x in xs]), F.lit(" |"))

    def lines(df: DataFrame, section: int, made: list[Column | str], at: Column | None = None, key: Column | None = None) -> DataFrame:
        texts = F.array(*[(F.lit(m) if isinstance(m, str) else m).cast("string") for m in made])
        placed = df.select(run.cast("string").alias("report"), F.lit(section).alias("section"), (F.lit(0) if at is None else at).cast("long").alias("a"), (F.lit("") if key is None else key.cast("string")).alias("c"), F.posexplode(texts).alias("b", "line"))
        return placed

    wide = metrics.where(F.col("metric").isin("wordCount", "questionCount", "directAnswerCount", "schemaTypeCount", "hasTrustSignals")).groupBy("run_id", "input_order").pivot("metric", ["wordCount", "questionCount", "directAnswerCount", "schemaTypeCount", "hasTrustSignals"]).agg(F.max("number").cast("long"))
    matrix = sites.join(wide, ["run_id", "input_order"])
    trust = F.when(F.col("hasTrustSignals") > 0, "Observed").otherwise("Not observed")
    gaps = conclusions.where("kind = 'gap'")
    ids = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("rule_id")))), ", ")
    groups = runs.select("run_id").join(conclusions.groupBy("run_id").agg(ids("advantage").alias("adv"), ids("shared").alias("shared"), ids("gap").alias("gaps")), "run_id", "left")
    or_none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))
    parts = [
        lines(runs, 0, ["# Research report", "", F.concat(F.lit("- Run: "), run.cast("string")), F.concat(F.lit("- Target: "), F.col("target_url")), "", "## Pages", "", "| Order | Role | URL | Eligibility | Findings |", "| ---: | --- | --- | --- | ---: |"]),
        lines(sites, 1, [flat(F.col("input_order"), F.col("role"), F.col("final_url"), F.col("eligibility"), F.col("findings"))], F.col("input_order")),
        lines(runs, 2, ["", "## Matrix", "", "| Role | URL | Words | Questions | Answers | Types | Trust |", "| --- | --- | ---: | ---: | ---: | ---: | --- |"]),
        lines(matrix, 3, [flat(F.col("role"), F.col("final_url"), F.col("wordCount"), F.col("questionCount"), F.col("directAnswerCount"), F.col("schemaTypeCount"), trust)], F.col("input_order")),
        lines(runs, 4, ["", "## Gaps", ""]),
        lines(gaps, 5, [F.concat_ws(" - ", F.concat(F.lit("### "), F.col("rule_id")), "metric"), "", F.concat(F.lit("- Target: "), F.floor("target").cast("string")), F.concat(F.lit("- Benchmark: "), F.floor("benchmark").cast("string")), F.concat(F.lit("- Priority: "), F.col("priority")), ""], None, F.col("rule_id")),
        lines(groups, 6, ["## Groups", "", F.concat(F.lit("- Advantages: "), or_none(F.col("adv"))), F.concat(F.lit("- Competitors' advantages: "), or_none(F.col("gaps"))), F.concat(F.lit("- Shared gaps: "), or_none(F.col("shared"))), "", "## Proposals", ""]),
        lines(proposals, 7, [F.concat_ws(" - ", F.concat(F.lit("### "), F.col("artifact_id")), "artifact_type"), "", F.concat(F.lit("> "), F.col("label")), "", "```", F.col("draft"), "```", "", F.concat(F.lit("Review: "), F.col("review_requirement")), ""], None, F.col("artifact_id")),
        lines(runs, 8, ["## Limitations", "", f"- {LIMITS['comparison-gap']}", f"- {LIMITS['finding']}", ""]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return numbered(out, ["section", "a", "c", "b"], "report").select("report", "number", "line")


def write(lines: DataFrame, path: str, newline: str = "\n") -> None:
    """Text files below ``path`` whose contents, in the order of their names, are the reports one after the other; CSV wants ``\\r\\n``."""
    lines.repartitionByRange("report", "number").sortWithinPartitions("report", "number").select("line").write.option("lineSep", newline).text(path)
