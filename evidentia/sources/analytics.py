"""Projects, sources, imports, metrics, opportunities and their audit trail, saved so that a change is seen whole or not at all."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import facts, opportunities
from evidentia.sources.store import Invalid, Snapshot, TableStore, duplicates, orphans

TABLES = ("projects", "sources", "import_jobs", "import_rejections", "metrics", "opportunities", "opportunity_evidence", "audit_events")
#: What each table refers to: its column, the table and the column there.
REFERENCES = {
    "sources": (("project_id", "projects", "project_id"),),
    "import_jobs": (("project_id", "projects", "project_id"), ("source_id", "sources", "source_id")),
    "import_rejections": (("import_id", "import_jobs", "import_id"),),
    "metrics": (("import_id", "import_jobs", "import_id"), ("source_id", "sources", "source_id"), ("project_id", "projects", "project_id")),
    "opportunities": (("project_id", "projects", "project_id"),),
    "opportunity_evidence": (("opportunity_id", "opportunities", "opportunity_id"), ("metric_id", "metrics", "metric_id")),
    "audit_events": (("project_id", "projects", "project_id"),),
}
#: Columns whose values stand once in a table.
UNIQUE = {
    "projects": (("project_id",),), "sources": (("source_id",),), "import_jobs": (("import_id",),), "import_rejections": (("import_id", "row_number"),),
    "metrics": (("metric_id",), ("project_id", "source_id", "source_record_id"), ("project_id", "source_id", "record_hash")),
    "opportunities": (("opportunity_id",), ("project_id", "rule_id", "group_key")), "opportunity_evidence": (("opportunity_id", "metric_id"),), "audit_events": (("event_id",),),
}


class Job(NamedTuple):
    """One import: who, from where, and the file it came from."""

    import_id: str
    project_id: str
    connector: str
    label: str
    now: datetime
    file_name: str = ""
    mime_type: str = "text/csv"
    file_sha256: str = ""
    mapping: dict[str, str] | None = None
    limitations: tuple[str, ...] = ("The file itself is not kept.",)


class AnalyticsStore:
    """The tables of ``TABLES`` in a ``TableStore``. Every change writes its audit event in the same save."""

    def __init__(self, store: TableStore):
        self.store, self.spark = store, store.spark

    def _row(self, schema: str, *values: Any) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def _event(self, project: str, at: datetime, kind: str, about: str, summary: dict[str, Any]) -> DataFrame:
        return self._row("event_id string, project_id string, occurred_at timestamp, event_type string, about string, summary string", f"audit:{kind}:{about}:{at.isoformat()}", project, at, kind, about, json.dumps(summary, sort_keys=True))

    def _has(self, name: str, condition: str, **values: str) -> bool:
        return self.store.exists(name) and not self.store.read(name).where(F.expr(condition) if not values else _all(values)).isEmpty()

    def register_project(self, project_id: str, target_url: str, created_at: datetime) -> bool:
        """Adds a project; the same one again changes nothing (False), another one under its id is refused."""
        new = self._row("project_id string, target_url string, created_at timestamp", project_id, target_url, created_at)
        if self.store.exists("projects") and (known := self.store.read("projects").where(F.col("project_id") == project_id).first()):
            if (known["target_url"], known["created_at"]) != (target_url, created_at):
                raise Invalid(f"project {project_id} is another one")
            return False
        with self.store.save() as s:
            s.insert_new("projects", new, ["project_id"])
        return True

    def save_import(self, judged: DataFrame, job: Job) -> None:
        """Saves an import's judged rows (``facts.judge``): source, job, rejections, metrics, opportunities, their evidence and an audit event.

        An import id is saved once; its project must be registered, and its source must be the stored one. A stored
        opportunity keeps its status and creation time, evidence that is there already stays as it is. ``judged`` is read several
        times, so it should be a stored table or persisted.
        """
        if not self._has("projects", "", project_id=job.project_id):
            raise Invalid(f"project {job.project_id} isn't registered")
        if self._has("import_jobs", "", import_id=job.import_id):
            raise Invalid(f"import {job.import_id} is saved already")
        accepted = judged.where("error_code is null").drop("error_code", "error_field")
        rejected = judged.where("error_code is not null").select(F.lit(job.import_id).alias("import_id"), F.lit(job.project_id).alias("project_id"), "row_number", F.col("error_code").alias("code"), F.col("error_field").alias("field"))
        n = facts.counters(judged).first()
        source = self._row("project_id string, connector string, label string", job.project_id, job.connector, job.label.strip())
        source = source.withColumn("source_id", facts.source_id(F.col("project_id"), F.col("connector"), F.col("label")))
        source_id = source.first()["source_id"]
        status = "completed-with-rejections" if n["rejected"] else "completed"
        done = self._row(
            "import_id string, project_id string, source_id string, created_at timestamp, completed_at timestamp, status string, file_name string, mime_type string, file_sha256 string, mapping map<string,string>, "
            "total_rows long, accepted_rows long, rejected_rows long, duplicate_rows long, date_from date, date_to date, limitations array<string>",
            job.import_id, job.project_id, source_id, job.now, job.now, status, job.file_name.replace("\\", "/").split("/")[-1], job.mime_type.strip().lower(), job.file_sha256, job.mapping or {},
            n["accepted"] + n["rejected"], n["accepted"], n["rejected"], n["duplicates"], n["date_from"], n["date_to"], list(job.limitations),
        )
        found = opportunities.opportunities(accepted)
        now = F.lit(job.now).cast("timestamp")
        fresh = found.drop("metric_ids").withColumns({"status": F.lit("new"), "created_at": now, "updated_at": now})
        links = found.select("opportunity_id", F.explode("metric_ids").alias("metric_id"))
        event = self._event(job.project_id, job.now, "import.completed", job.import_id, {"connector": job.connector, "accepted": n["accepted"], "rejected": n["rejected"], "duplicates": n["duplicates"]})
        with self.store.save(tag=f"import:{job.import_id}") as s:
            if self._has("sources", "", source_id=source_id) and self.store.read("sources").join(source, source.columns, "left_semi").isEmpty():
                raise Invalid(f"source {source_id} is another one")
            s.insert_new("sources", source, ["source_id"])
            s.append("import_jobs", done)
            s.append("import_rejections", rejected)
            s.append("metrics", accepted)
            s.merge("opportunities", fresh, ["opportunity_id"], keep=("status", "created_at"))
            s.insert_new("opportunity_evidence", links, ["opportunity_id", "metric_id"])
            s.append("audit_events", event)

    def delete_import(self, project_id: str, import_id: str, at: datetime) -> bool:
        """The job, its rejections, metrics and evidence links go; opportunities, the source and the audit stay. False where there is none."""
        if not self._has("import_jobs", "", project_id=project_id, import_id=import_id):
            return False
        own = lambda df: df.where((F.col("project_id") == project_id) & (F.col("import_id") == import_id))
        with self.store.save() as s:
            gone = own(s.base.read("metrics")).select("metric_id")
            s.delete("import_jobs", own, ["import_id"])
            s.delete("import_rejections", own, ["import_id", "row_number"])
            s.delete("opportunity_evidence", lambda df: df.join(gone, "metric_id", "left_semi"), ["opportunity_id", "metric_id"])
            s.delete("metrics", own, ["metric_id"])
            s.append("audit_events", self._event(project_id, at, "import.deleted", import_id, {}))
        return True

    def set_status(self, project_id: str, opportunity_id: str, status: str, at: datetime) -> bool:
        """Any of the known states after any other; False where there is no such opportunity."""
        if status not in opportunities.STATES:
            raise Invalid(f"unknown status {status}")
        if not self._has("opportunities", "", project_id=project_id, opportunity_id=opportunity_id):
            return False
        with self.store.save() as s:
            row = s.base.read("opportunities").where(_all({"project_id": project_id, "opportunity_id": opportunity_id}))
            s.merge("opportunities", opportunities.set_status(row, opportunity_id, status, F.lit(at).cast("timestamp")), ["opportunity_id"])
            s.append("audit_events", self._event(project_id, at, "opportunity.status-changed", opportunity_id, {"status": status}))
        return True

    def _list(self, name: str, project_id: str, *newest: str, **more: str) -> DataFrame:
        rows = self.store.read(name).where(_all({"project_id": project_id, **more}))
        return rows.orderBy(*[F.desc(c) for c in newest[:1]], *newest[1:]) if newest else rows

    def projects(self) -> DataFrame:
        return self.store.read("projects").orderBy(F.desc("created_at"), "project_id")

    def project(self, project_id: str) -> DataFrame:
        return self.store.read("projects").where(F.col("project_id") == project_id)

    def sources(self, project_id: str) -> DataFrame:
        return self._list("sources", project_id)

    def imports(self, project_id: str) -> DataFrame:
        return self._list("import_jobs", project_id, "created_at", "import_id")

    def rejections(self, project_id: str, import_id: str) -> DataFrame:
        return self._list("import_rejections", project_id, import_id=import_id)

    def metrics(self, project_id: str, **filters: str) -> DataFrame:
        """A project's metrics through ``facts.filter_metrics``."""
        return facts.filter_metrics(self._list("metrics", project_id), **filters)

    def metric(self, project_id: str, metric_id: str) -> DataFrame:
        return self._list("metrics", project_id, metric_id=metric_id)

    def opportunities(self, project_id: str) -> DataFrame:
        return self._list("opportunities", project_id, "updated_at", "opportunity_id")

    def opportunity(self, project_id: str, opportunity_id: str) -> DataFrame:
        return self._list("opportunities", project_id, opportunity_id=opportunity_id)

    def evidence(self, project_id: str, opportunity_id: str | None = None) -> DataFrame:
        """Links of a project's opportunities (or of one) to metrics."""
        own = self._list("opportunities", project_id, **({"opportunity_id": opportunity_id} if opportunity_id else {})).select("opportunity_id")
        return self.store.read("opportunity_evidence").join(own, "opportunity_id", "left_semi")

    def audit(self, project_id: str) -> DataFrame:
        return self._list("audit_events", project_id, "occurred_at", "event_id")

    def integrity(self) -> DataFrame:
        """``check, id`` of broken references and repeated keys over all tables of one manifest; no rows where all is well."""
        snap = self.store.snapshot()
        return violations({n: snap.read(n) for n in TABLES if n in snap.said["tables"]}, self.spark)


def _all(values: dict[str, str]):
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == value)
    return out


def violations(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``check, id``: references of the given tables to rows that aren't there, and keys that stand more than once."""
    out = spark.createDataFrame([], "check string, id string")
    for name, refs in REFERENCES.items():
        for column, parent, key in refs:
            if name in tables and column in tables[name].columns:
                lost = tables[name].where(F.col(column).isNotNull()) if parent not in tables else orphans(tables[name], column, tables[parent], key)
                out = out.unionByName(lost.select(F.lit(f"{name}.{column}").alias("check"), F.col(column).cast("string").alias("id")).distinct())
    for name, sets in UNIQUE.items():
        for keys in sets:
            if name in tables and set(keys) <= set(tables[name].columns):
                found = duplicates(tables[name], *keys)
                out = out.unionByName(found.select(F.lit(f"{name} by {'+'.join(keys)}").alias("check"), F.concat_ws("|", *keys).alias("id")))
    return out


__all__ = ["AnalyticsStore", "Job", "Snapshot", "violations"]
