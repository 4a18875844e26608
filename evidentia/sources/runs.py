"""Saved comparison runs as append-only tables, their summaries, and the audit that recomputes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import compare, history
from evidentia.sources.store import TableStore, eligibility_violations, orphans

TABLES = ("runs", "run_sites", "run_metrics", "run_conclusions", "run_proposals")


def save(store: TableStore, run: DataFrame, sites: DataFrame, metrics: DataFrame, conclusions: DataFrame, proposals: DataFrame, more: dict[str, DataFrame] | None = None) -> None:
    """``run`` has ``run_id, target_url, created_at`` (and a label). All tables are published at once, with ``more`` ones (pages, findings,
    evidence, verification), so no reader sees half a run and a crash leaves none. A run id that exists already is refused."""
    if store.exists("runs") and not store.read("runs").join(run.select("run_id"), "run_id", "left_semi").isEmpty():
        raise ValueError("the run is saved already")
    ids = sorted(str(r["run_id"]) for r in run.select("run_id").distinct().collect())  # of the runs that are saved now
    with store.save(tag="runs:" + ",".join(ids)) as s:
        for name, df in (*zip(TABLES, (run, sites, metrics, conclusions, proposals), strict=True), *(more or {}).items()):
            s.append(name, df)


def latest(store: TableStore, exclude: str | None = None) -> DataFrame:
    """The newest run of each target, by time and then id; one run may be left out."""
    runs = store.read("runs")
    return history.latest(runs if exclude is None else runs.where(F.col("run_id") != exclude), "target_url", "created_at", "run_id")


def summaries(store: TableStore) -> DataFrame:
    """``run_id, target_url, created_at, sites, gaps, has_previous``, newest first."""
    runs = store.read("runs")
    sites = store.read("run_sites").groupBy("run_id").agg(F.count("*").alias("sites"))
    gaps = store.read("run_conclusions").where("kind = 'gap'").groupBy("run_id").agg(F.count("*").alias("gaps"))
    first = runs.groupBy("target_url").agg(F.min("created_at").alias("_first"))
    out = runs.join(sites, "run_id", "left").join(gaps, "run_id", "left").join(first, "target_url")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("run_id", "target_url", "created_at", zero("sites"), zero("gaps"), (F.col("created_at") > F.col("_first")).alias("has_previous")).orderBy(F.desc("created_at"), "run_id")


def audit(store: TableStore) -> DataFrame:
    """``check, run_id`` of stored runs that contradict themselves: conclusions or proposals that differ from those
    recomputed from the stored metrics, sites without a run, a target that isn't exactly one, odd eligibility."""
    metrics, stored, sites = store.read("run_metrics"), store.read("run_conclusions"), store.read("run_sites")
    again = compare.conclusions(metrics).select(*stored.columns)
    differ = stored.exceptAll(again).unionByName(again.exceptAll(stored))
    wanted = compare.proposals(stored)
    artifacts = store.read("run_proposals").select(*wanted.columns)
    artifacts = artifacts.exceptAll(wanted).unionByName(wanted.exceptAll(artifacts))
    targets = sites.groupBy("run_id").agg(F.count_if(F.col("input_order") == 0).alias("n"), F.count("*").alias("all")).where("n <> 1 or all not between 2 and 6")
    parts = {"conclusions": differ, "proposals": artifacts, "orphans": orphans(sites, "run_id", store.read("runs"), "run_id"), "sites": targets, "eligibility": eligibility_violations(sites)}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("check"), "run_id").distinct()
        out = row if out is None else out.unionByName(row)
    return out
