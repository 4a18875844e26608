"""One place for the workflows: analyse pages, compare sites, crawl, import a CSV export, follow up runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.html import parse_pages
from evidentia.operators import compare as C
from evidentia.operators import artifacts, coverage, eligibility, evidence, facts, opportunities, page_analysis, rules
from evidentia.sources import csv_facts


class Analysis(NamedTuple):
    pages: DataFrame
    findings: DataFrame
    observations: DataFrame


def analyze(pages: DataFrame, key: str = "page_id") -> Analysis:
    """``pages`` has ``key, url, html`` and optional retrieval columns; parsed once and kept for all three results."""
    extra = tuple(c for c in ("status_code", "redirect_count", "robots_txt_available", "sitemap_xml_available", "robots_txt_status_code", "sitemap_xml_status_code", "run_id", "input_order") if c in pages.columns)
    wide = coverage.with_coverage(page_analysis.analyze(parse_pages(pages, keep=(key, *extra)).persist()), key)
    return Analysis(wide, rules.findings(wide, key), rules.observations(wide, key))


class Comparison(NamedTuple):
    sites: DataFrame
    metrics: DataFrame
    conclusions: DataFrame
    proposals: DataFrame
    status: DataFrame
    evidence: DataFrame


def compare(pages: DataFrame) -> Comparison:
    """``pages`` also has ``run_id`` and ``input_order`` (0: the target). Conclusions hold numbers, flags, shared gaps and values that only
    competitors have, with category and confidence; ``evidence`` has the bundles behind each, ``proposals`` a draft for each gap."""
    sites = analyze(pages).pages.withColumn("e", eligibility.of_analysis()).withColumns({"usable": F.col("e.usable"), "eligibility": F.col("e.status")})
    metrics = C.long_metrics(sites)
    found = C.every_conclusion(sites, metrics)
    return Comparison(sites, metrics, found, artifacts.written(C.proposals(found), found), C.status(sites), evidence.bundles(found, evidence.with_signals(sites)))


class Import(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame
    counters: DataFrame
    opportunities: DataFrame


def import_csv(spark: SparkSession, path: str, connector: str, project_id: str, label: str, import_id: str, mapping: dict[str, str] | None = None, stored: DataFrame | None = None) -> Import:
    csv_facts.gate(path.rstrip("/").split("/")[-1], "text/csv")
    rows = csv_facts.read(spark, path)
    headers = [c for c in rows.columns if c != "row_number"]
    mapping = mapping or facts.suggest_mapping(headers, connector)
    facts.check_mapping(mapping, headers, connector)
    judged = facts.judge(facts.normalize(rows, connector, mapping, project_id, label, import_id), stored).persist()
    accepted = judged.where("error_code is null").drop("error_code", "error_field")
    rejected = judged.where("error_code is not null").select("row_number", "error_code", "error_field")
    return Import(accepted, rejected, facts.counters(judged), opportunities.opportunities(accepted))
