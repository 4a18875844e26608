"""Saved runs: append, latest, summaries, audit."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import compare
from evidentia.sources import runs
from evidentia.sources.store import TableStore


def parts(spark, run, words):
    run_row = spark.createDataFrame([(run, "https://t.example/", f"2026-01-0{run}")], "run_id long, target_url string, created_at string")
    sites = spark.createDataFrame([(run, 0, True, "eligible", 0), (run, 1, True, "eligible", 0)], "run_id long, input_order int, usable boolean, eligibility string, n_reasons int")
    metrics = spark.createDataFrame([(run, 0, True, "wordCount", 100.0, None), (run, 1, True, "wordCount", words, None)], "run_id long, input_order int, usable boolean, metric string, number double, label string")
    found = compare.conclusions(metrics)
    return run_row, sites, metrics, found, compare.proposals(found)


def test_runs(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    runs.save(store, *parts(spark, 1, 150.0))
    runs.save(store, *parts(spark, 2, 900.0))
    with pytest.raises(ValueError):
        runs.save(store, *parts(spark, 2, 900.0))
    assert runs.latest(store).first()["run_id"] == 2
    assert [(r["run_id"], r["gaps"], r["has_previous"]) for r in runs.summaries(store).collect()] == [(2, 1, True), (1, 0, False)]
    assert runs.audit(store).count() == 0
    store.replace("run_conclusions", store.read("run_conclusions").withColumn("benchmark", F.lit(5.0)))
    store.replace("run_sites", store.read("run_sites").withColumn("usable", F.lit(False)).where("run_id = 1 or input_order = 1"))
    assert {(r["check"], r["run_id"]) for r in runs.audit(store).collect()} == {("conclusions", 2), ("sites", 2), ("eligibility", 1), ("eligibility", 2)}


def test_store_appends_without_rewriting(spark, tmp_path):
    """Old readers stay undisturbed, a replayed append adds nothing, a stale writer is refused, a lost publish changes nothing."""
    import pytest

    from evidentia.sources.store import Conflict, TableStore

    store, rows = TableStore(spark, str(tmp_path / "s")), lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    values = lambda df: sorted(r["x"] for r in df.collect())
    assert not store.exists("t")
    with pytest.raises(KeyError):
        store.read("t")
    store.append("t", rows(1, 2), tag="b0")
    before = store.read("t")
    parts = [p["path"] for p in store.parts("t")]
    store.append("t", rows(3), tag="b1")
    store.append("t", rows(3), tag="b1")
    assert [p["path"] for p in store.parts("t")][:1] == parts and values(before) == [1, 2] and values(store.read("t")) == [1, 2, 3]
    number, said = store._current()
    store.append("t", rows(4))
    with pytest.raises(Conflict):
        store._publish(number, said)
    assert values(store.read("t")) == [1, 2, 3, 4]
    store.save()._write("t", rows(9), ())  # a writer that dies before it publishes
    assert values(store.read("t")) == [1, 2, 3, 4]
    store.replace("t", rows(7))
    store.append("t", spark.createDataFrame([(8, "new")], "x long, y string"))
    assert values(store.read("t")) == [7, 8] and store.read("t").columns == ["x", "y"]


def test_stream_replay_adds_nothing(spark, tmp_path, monkeypatch):
    from evidentia.sources.store import TableStore
    from evidentia.streaming import incremental

    monkeypatch.setattr(incremental, "split_duplicates", lambda rows, known: (rows, None))
    spark.createDataFrame([(1,), (2,)], "x long").write.parquet(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "s"))
    run = lambda: incremental.ingest(spark.readStream.schema("x long").parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), lambda df: df).awaitTermination()
    run()
    run()
    store.append("metrics", spark.createDataFrame([(1,)], "x long"), tag=f"{tmp_path / 'c'}#0")  # the batch once more
    assert sorted(r["x"] for r in store.read("metrics").collect()) == [1, 2]


def test_run_diff_compares_content_of_usable_pages_only(spark):
    from evidentia.operators.history import run_diff

    schema = "site_key string, role string, usable boolean, eligibility string, status_code long, title string, schema_types array<string>"
    a = spark.createDataFrame([("a", "target", True, "eligible", 200, "Old", ["FAQPage", "Person"]), ("b", "competitor", True, "eligible", 200, "B", ["X"]), ("gone", "competitor", True, "eligible", 200, "G", [])], schema)
    b = spark.createDataFrame([("a", "target", True, "eligible", 301, None, ["faqpage", "Offer"]), ("b", "competitor", False, "ineligible", 503, "Denied", ["Y"]), ("new", "competitor", True, "eligible", 200, "N", [])], schema)
    got = {tuple(r) for r in run_diff(a, b).collect()}
    assert got == {
        ("a", "target", "technical", "status_code", "changed", "200", "301"), ("a", "target", "metadata", "title", "removed", "Old", None),
        ("a", "target", "schema", "schema_types", "added", None, "Offer"), ("a", "target", "schema", "schema_types", "removed", "Person", None),
        ("b", "competitor", "technical", "status_code", "changed", "200", "503"), ("b", "competitor", "technical", "eligibility", "changed", "eligible", "ineligible"),
    }
    assert run_diff(a.limit(0), b).count() == 0


def test_lexical_observations_have_values_and_boundaries(spark):
    from evidentia.operators.rules import lexical_observations, lexical_statuses

    texts = ["The authority spoke.", "See Dr Smith.", "Dr. Who", "Élan vital means energy and more.", "Fees apply; how\u00a0it works", "Updated on: 5 May", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    full = {(r["i"], r["analyzer_id"]): r for r in df.selectExpr("i", "text").select("i", F.inline(lexical_observations(F.col("text")))).collect()}
    short = {(r["i"], r["analyzer_id"]): r["status"] for r in df.select("i", F.inline(lexical_statuses(F.col("text")))).collect()}
    assert {k: r["status"] for k, r in full.items()} == short
    seen = {k: r["observed_value"] for k, r in full.items() if r["status"] == "observed"}
    assert (0, "ENTITY_PROVIDER") not in seen and seen[1, "ENTITY_PROVIDER"] == "Dr" and seen[2, "ENTITY_PROVIDER"] == "Dr"
    assert seen[4, "CONTENT_PRICING"] == "Fees" and (4, "CONTENT_PROCESS") not in seen and full[5, "CONTENT_REVIEW_DATE"]["snippet"] == "Updated on: 5 May"
    assert short[6, "CONTENT_RISKS"] == "needs-human-review" and full[4, "CONTENT_PRICING"]["group"] == "content-answerability"
