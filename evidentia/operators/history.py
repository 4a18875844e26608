"""Run-to-run history and verification: set changes, field changes, rank and order moves, status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(runs: DataFrame, by: str, *order: str) -> DataFrame:
    """The newest row of each ``by``: the largest ``order`` columns, first to last."""
    w = Window.partitionBy(by).orderBy(*[F.col(o).desc() for o in order])
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def set_changes(previous: DataFrame, current: DataFrame, keys: list[str], comparable: Column | None = None) -> DataFrame:
    """``keys`` with ``change``: new, resolved or unchanged; without comparability what isn't common is indeterminate."""
    a = previous.select(*keys).distinct().withColumn("_p", F.lit(True))
    b = current.select(*keys).distinct().withColumn("_c", F.lit(True))
    kind = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "resolved").otherwise("unchanged")
    if comparable is not None:
        kind = F.when(comparable | (kind == "unchanged"), kind).otherwise("indeterminate")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def regressions(changes: DataFrame, resolved_before: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` where what is new but was resolved earlier is ``regressed``."""
    again = resolved_before.select(*keys).distinct().withColumn("_r", F.lit(True))
    out = changes.join(again, keys, "left")
    return out.withColumn("change", F.when((F.col("change") == "new") & F.col("_r"), "regressed").otherwise(F.col("change"))).drop("_r")


def field_changes(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, change, old, new`` of every field whose canonical text differs; emptiness decides the kind."""
    text = lambda df, f: F.to_json(F.struct(F.col(f).alias("v"))) if df.schema[f].dataType.typeName() in ("array", "struct", "map") else F.col(f).cast("string")
    wide = lambda df, name: df.select(key, F.struct(*[text(df, f).alias(f"f{i}") for i, f in enumerate(fields)]).alias(name))
    pairs = wide(previous, "_old").join(wide(current, "_new"), key)
    both = pairs.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old.f{i}").alias("old"), F.col(f"_new.f{i}").alias("new")) for i, f in enumerate(fields)]))).where(~F.col("old").eqNullSafe(F.col("new")))
    empty = lambda x: x.isNull() | x.isin("", '{"v":[]}', "{}")
    return both.withColumn("change", F.when(empty(F.col("old")), "added").when(empty(F.col("new")), "removed").otherwise("changed"))


# Tracked fields of a page analysis by category of change; names are those of the analysis' columns.
TRACKED = {
    "technical": ("status_code", "url", "redirect_count", "robots_txt_available", "robots_txt_status_code", "sitemap_xml_available", "sitemap_xml_status_code", "indexability"),
    "metadata": ("title", "title_length", "meta_description", "meta_description_length", "canonical_href", "canonical_status", "robots_meta", "document_language", "viewport_present"),
    "schema": ("jsonld_error_count",),
    "headings": ("h1_count", "headings", "heading_count", "level_jumps", "empty_heading_count", "repeated_headings"),
    "content": ("word_count", "sentence_count", "question_count", "detected_questions", "faq_indicators", "breadcrumbs", "direct_answer_count", "direct_answers"),
    "links": ("internal_link_count", "external_link_count", "internal_urls", "external_urls", "external_domains", "empty_anchor_count"),
    "media": ("image_count", "images_missing_alt"),
}


def run_diff(previous: DataFrame, current: DataFrame, key: str = "site_key", tracked: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key, scope, category, field, change, old, new``: what differs between two runs' sites that both have.

    Sites have ``role`` (of the current run), ``usable``, ``eligibility`` and ``schema_types``. Without usable pages on both
    sides only technical fields are compared; a change of eligibility is technical; schema types are compared without regard to
    case, and one row is given for each type that came or went. Fields that a side lacks are not compared.
    """
    have = set(previous.columns) & set(current.columns)
    wanted = {c: [f for f in fields if f in have] for c, fields in (tracked or TRACKED).items()}
    category = F.create_map(*[F.lit(x) for c, fields in wanted.items() for f in [*fields] for x in (f, c)], F.lit("eligibility"), F.lit("technical"))
    state = previous.select(key, F.col("usable").alias("_was")).join(current.select(key, F.col("role").alias("scope"), (F.col("usable")).alias("_is")), key)
    state = state.select(key, "scope", (F.col("_was") & F.col("_is")).alias("_ok"))
    fields = field_changes(previous, current, key, [*(f for fs in wanted.values() for f in fs), "eligibility"]).join(state, key)
    fields = fields.withColumn("category", category[F.col("field")]).where(F.col("_ok") | (F.col("category") == "technical"))
    folded = lambda df, name: df.select(key, F.explode("schema_types").alias("v")).groupBy(key, F.lower(F.btrim("v")).alias("k")).agg(F.min("v").alias(name))
    types = folded(previous, "old").join(folded(current, "new"), [key, "k"], "full_outer").where(F.col("old").isNull() | F.col("new").isNull())
    types = types.join(state.where("_ok"), key).withColumns({"category": F.lit("schema"), "field": F.lit("schema_types"), "change": F.when(F.col("old").isNull(), "added").otherwise("removed")})
    out = [key, "scope", "category", "field", "change", "old", "new"]
    return fields.select(*out).unionByName(types.select(*out))


def rank_changes(previous: DataFrame, current: DataFrame, key: str, rank: str) -> DataFrame:
    """Positions that differ, null-safe: ``delta`` is current minus previous, null where one side is missing."""
    a, b = previous.select(key, F.col(rank).alias("old")), current.select(key, F.col(rank).alias("new"))
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("delta", F.col("new") - F.col("old"))


def order_moves(previous: DataFrame, current: DataFrame, run: str, key: str, order: str) -> DataFrame:
    """Members of both sides of a run whose place among the common ones differs."""
    common = previous.select(run, key).intersect(current.select(run, key))
    placed = lambda df, name: df.join(common, [run, key], "left_semi").select(run, key, F.row_number().over(Window.partitionBy(run).orderBy(order)).alias(name))
    return placed(previous, "old_place").join(placed(current, "new_place"), [run, key]).where("old_place <> new_place")


def analyzer_changes(previous: DataFrame, current: DataFrame, key: str = "analyzer_id") -> DataFrame:
    """``key`` with ``change`` between observations (status, version): new, resolved, unchanged, regressed or changed."""
    a = previous.select(key, F.col("status").alias("old"), F.col("version").alias("old_version"))
    b = current.select(key, F.col("status").alias("new"), F.col("version").alias("new_version"))
    good = lambda x: x.isin("observed", "not-applicable")
    kind = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "resolved").when(F.col("old_version") != F.col("new_version"), "changed")
        .when(F.col("old") == F.col("new"), "unchanged").when(good(F.col("old")) & ~good(F.col("new")), "regressed").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, "old", "new", kind.alias("change"))


def proposal_links(artifacts: DataFrame, gaps: DataFrame, resolved_before: DataFrame, target_usable: Column) -> DataFrame:
    """What became of each proposal (``artifact_id, rule_id``): indeterminate, regressed, unchanged or resolved."""
    now = gaps.select("rule_id").distinct().withColumn("_g", F.lit(True))
    earlier = resolved_before.select("artifact_id").distinct().withColumn("_r", F.lit(True))
    kind = F.when(~target_usable, "indeterminate").when(F.col("_g") & F.col("_r"), "regressed").when(F.col("_g"), "unchanged").otherwise("resolved")
    return artifacts.join(now, "rule_id", "left").join(earlier, "artifact_id", "left").select("artifact_id", "rule_id", kind.alias("change"))


def correlation(target_rank_changed: Column, target_changes: Column) -> Column:
    """A fixed text that never claims a cause."""
    return (
        F.when(target_rank_changed & (target_changes > 0), "Observed page changes and a rank change occurred in the same interval; this does not establish a cause.")
        .when(target_rank_changed, "A rank change was observed without observed page changes.").otherwise("No comparable rank change was observed.")
    )


def evidence_changes(diff: DataFrame) -> DataFrame:
    """All changes of a run diff as verification lists them: those of each category, then those of competitors once more, so a
    competitor's change counts twice."""
    return diff.withColumn("listed", F.explode(F.when(F.col("scope") == "competitor", F.array(F.lit("category"), F.lit("competitor"))).otherwise(F.array(F.lit("category")))))


def page_summary(sites: DataFrame, found: DataFrame, observed: DataFrame, key: str = "site_key") -> DataFrame:
    """``sites`` (``key, role, input_order, eligibility``) with their numbers of findings and of analyzer observations."""
    counts = [df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((found, "finding_count"), (observed, "observation_count"))]
    out = sites.select(key, "role", "input_order", "eligibility").join(counts[0], key, "left").join(counts[1], key, "left")
    return out.fillna(0, ["finding_count", "observation_count"])


def verification_counts(sites: DataFrame, changes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: compared pages, changed evidence records (as ``evidence_changes`` lists them) and resolved proposals."""
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    every = one(sites, "pages", F.count("*")).unionByName(one(changes, "changes", F.count("*"))).unionByName(one(links, "resolved", F.count_if(F.col("change") == "resolved")))
    return every.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(out) for name, out in (("pages", "compared_pages"), ("changes", "changed_evidence_records"), ("resolved", "resolved_artifacts"))])
