"""Chains of runs, histories of all runs at once, and audits that open only what differs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import urls as U
from evidentia.operators import history
from evidentia.sources.scratch import settled

MISSING, CYCLE = "unknown previous run", "cycle"
_SEP = "\x1f"


def chains(runs: DataFrame, run: str = "run_id", previous: str = "previous_id") -> DataFrame:
    """``run, previous, root, position, problem``: the first run of each one's chain and how many steps it is away.

    Pointers double: each round a run takes over its pointer's pointer, so chains of n runs take log2(n) rounds; runs that have
    reached a root take no part any more. A run whose previous one isn't there is a root with a problem; one that no round
    brings to a root lies in a cycle or behind one (no root, no position). Repeated run ids are an error.
    """
    nodes = runs.select(F.col(run).alias("run"), F.col(previous).alias("previous")).where("run is not null")
    if not nodes.groupBy("run").count().where("count > 1").isEmpty():
        raise ValueError("a run id stands more than once")
    ids = nodes.select(F.col("run").alias("previous"), F.lit(True).alias("known"))
    placed = settled(nodes.join(ids, "previous", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    start = F.when(F.col("known"), F.col("previous")).otherwise(F.col("run"))
    roots = placed.where(~F.col("known")).select(F.col("run").alias("to"), F.lit(True).alias("ends"))
    state = placed.select("run", start.alias("to"), F.col("known").cast("long").alias("steps"))
    state = settled(state.join(roots, "to", "left").select("run", "to", "steps", F.coalesce("ends", F.lit(False)).alias("ends")))
    done, active = state.where("ends"), state.where("not ends")
    for _ in range(math.ceil(math.log2(max(2, placed.count()))) + 1):
        if active.isEmpty():
            break
        ahead = done.unionByName(active).select(F.col("run").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("ends").alias("there"))
        moved = settled(active.select("run", "to", "steps").join(ahead, "to").select("run", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("ends")))
        done, active = done.unionByName(moved.where("ends")), moved.where("not ends")
    found = done.select("run", F.col("to").alias("root"), F.col("steps").alias("position"))
    out = placed.join(found, "run", "left")
    problem = F.when(F.col("root").isNull(), CYCLE).when((F.col("position") == 0) & F.col("previous").isNotNull(), MISSING)
    return out.select(F.col("run").alias(run), F.col("previous").alias(previous), "root", "position", problem.alias("problem"))


def legacy_sites(runs: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """``run_id, role, input_order, input_url, normalized_url, final_url, usable, known``: the stored sites, and for runs without any those that their URLs give.

    ``runs`` has ``run_id, target_url, competitor_urls``, ``pages`` (``run_id, requested_url, normalized_url, final_url, usable``) their analyses: a URL without one is its own
    final URL and not usable (``known`` is false).
    """
    out = ["run_id", "role", "input_order", "input_url", "normalized_url", "final_url", "usable"]
    bare = runs.join(sites.select("run_id"), "run_id", "left_anti")
    urls = bare.select("run_id", F.posexplode(F.concat(F.array("target_url"), F.coalesce("competitor_urls", F.array().cast("array<string>")))).alias("input_order", "given"))
    own = urls.withColumn("key", U.canonical(F.col("given")))
    by = pages.withColumn("key", U.canonical(F.col("normalized_url"))).groupBy("run_id", "key").agg(F.min(F.struct("requested_url", "normalized_url", "final_url", "usable")).alias("p"))
    role = F.when(F.col("input_order") == 0, "target").otherwise("competitor")
    made = own.join(by, ["run_id", "key"], "left").select(
        "run_id", role.alias("role"), "input_order", F.coalesce("p.requested_url", "given").alias("input_url"), F.coalesce("p.normalized_url", "key").alias("normalized_url"), F.coalesce("p.final_url", "key").alias("final_url"),
        F.coalesce("p.usable", F.lit(False)).alias("usable"), F.col("p").isNotNull().alias("known"),
    )
    return sites.select(*out, F.lit(True).alias("known")).unionByName(made)


def histories(sites: DataFrame, links: DataFrame, tracked: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``run_id, previous_id, site_key`` and the columns of ``history.run_diff`` for every run of ``links`` (``run_id, previous_id``) at once."""
    pair = F.concat_ws(_SEP, F.col("_pair").cast("string"), F.col("site_key").cast("string"))
    own = links.where("previous_id is not null").select("run_id", "previous_id")
    now = sites.join(own.select("run_id"), "run_id").withColumn("_pair", F.col("run_id")).withColumn("pair", pair)
    was = sites.withColumnRenamed("run_id", "previous_id").join(own, "previous_id").withColumn("_pair", F.col("run_id")).withColumn("pair", pair)
    found = history.run_diff(was, now, "pair", tracked)
    kind = sites.schema["run_id"].dataType
    parts = F.split("pair", _SEP, 2)
    return found.withColumns({"run_id": parts[0].cast(kind), "site_key": parts[1].cast(sites.schema["site_key"].dataType)}).drop("pair").join(own, "run_id")


def prints(rows: DataFrame, key: str) -> DataFrame:
    """``key`` with a fingerprint of its rows that doesn't depend on their order: number, xor and sum of their hashes. Equal rows count."""
    given = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c != key]), {"ignoreNullFields": "false"})
    h = rows.select(key, F.xxhash64(given).alias("h"), F.xxhash64(F.lit(1), given).alias("g"))
    return h.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor("g").alias("y"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s"))


def altered(stored: DataFrame, again: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, problem`` of keys whose stored rows aren't those that are computed again, by fingerprints alone."""
    a, b = prints(stored, key), prints(again.select(*stored.columns), key)
    both = a.select(key, F.struct("n", "x", "y", "s").alias("p")).join(b.select(key, F.struct("n", "x", "y", "s").alias("q")), key, "full_outer").where(~F.col("p").eqNullSafe(F.col("q")))
    return both.select(key, F.when(F.col("p").isNull(), "not stored").when(F.col("q").isNull(), "not expected").otherwise("differs").alias("problem"))


def opened(stored: DataFrame, again: DataFrame, key: str = "run_id") -> DataFrame:
    """The rows that differ, ``side`` stored or expected; only rows of keys that ``altered`` names are compared."""
    keys = settled(altered(stored, again, key).select(key))
    a, b = stored.join(keys, key, "left_semi"), again.select(*stored.columns).join(keys, key, "left_semi")
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))


def lost_references(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """``changes`` (``run_id, site_key``, and ``final_url`` where known) that name no ordered site of their run, or another final URL than it has."""
    known = sites.select("run_id", "site_key", F.col("final_url").alias("_final"), F.lit(True).alias("_site"))
    told = F.col("final_url") if "final_url" in changes.columns else F.lit(None).cast("string")
    problem = F.when(F.col("_site").isNull(), "no such site").when(told.isNotNull() & (told != F.col("_final")), "another final URL")
    return changes.join(known, ["run_id", "site_key"], "left").withColumn("problem", problem).where("problem is not null").drop("_final", "_site")


def rank_keys(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``run_id, site_key, place`` of the sites whose ranks are compared: the current run's in order, then those that only the previous one has."""
    both = current.select("run_id", "site_key", F.lit(0).alias("side"), "input_order").unionByName(previous.select("run_id", "site_key", F.lit(1).alias("side"), "input_order"))
    first = both.groupBy("run_id", "site_key").agg(F.min(F.struct("side", "input_order")).alias("at"))
    return first.select("run_id", "site_key", F.row_number().over(Window.partitionBy("run_id").orderBy("at")).alias("place"))


def scoped_ranks(ranks: DataFrame, keys: DataFrame, key: Column | str = "url") -> DataFrame:
    """Ranks (``run_id, url, position``) of the runs' own sites; those of other URLs don't count."""
    site = U.canonical(F.col(key) if isinstance(key, str) else key)
    return ranks.withColumn("site_key", site).join(keys.select("run_id", "site_key"), ["run_id", "site_key"], "left_semi")
