"""All registered queries over the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import analysis_queries, crawl_queries, document_queries, evidence_queries, fact_queries, lineage_queries, page_queries, report_queries, run_queries, verification_queries

_MODULES = (page_queries, crawl_queries, analysis_queries, document_queries, evidence_queries, fact_queries, run_queries, lineage_queries, report_queries, verification_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
