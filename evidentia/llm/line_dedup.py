"""Line dedup by distinct-site spread: lines found on many sites are boilerplate and go.

Main path: DataFrame functions only. A line is known by a 128-bit hash; HyperLogLog sketches of the
sites of each line merge by aggregation, and only lines near the threshold are counted exactly. A line's
occurrences are combined within tasks before each shuffle, and joins deal a hot line to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fresh, let, refuse, split_join, written

_BLANK = " \t\n\x0b\x0c\r"
#: Places of lines to be cut (ints, three more for each text) up to which they are broadcast: about 16 MB.
SMALL_PLACES = 1_000_000


def _key(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit("second"), x)]


def _lines(docs: DataFrame, text: str, site: str | None) -> DataFrame:
    """One row for each line with a word: its text's key, place, key and number of characters."""
    t1, t2 = _key(F.col(text))
    base = docs.where(F.col(text).isNotNull()).select(
        t1.alias("t1"), t2.alias("t2"), *([F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site")] if site else []),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"),
    )
    line = F.btrim(F.col("raw"), F.lit(_BLANK))
    h1, h2 = _key(F.col("line"))
    out = base.withColumn("line", line).where(F.length("line") > 0)
    return out.select(*(["site"] if site else ["t1", "t2", "pos", F.length("line").alias("chars")]), h1.alias("h1"), h2.alias("h2"))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, band: float = 0.25, log_k: int = 12) -> DataFrame:
    """``h1, h2`` of each line found on ``min_sites`` sites or more; a null site counts as one site.

    A first count (combined before the shuffle) leaves lines with enough occurrences and two sites at
    least; their sketches, merged, decide all lines outside ``min_sites`` * (1 ± ``band``), which is over
    ten standard errors at ``log_k`` = 12; the others get an exact distinct count.
    """
    lines = _lines(docs, text, site)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = written(often.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select("h1", "h2"))
    of_often = split_join(lines, often, ["h1", "h2"])
    sketched = of_often.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("sites"))
    sketched = written(sketched.where(F.col("sites") >= min_sites * (1 - band)))
    near = sketched.where(F.col("sites") <= min_sites * (1 + band)).select("h1", "h2")
    exact = split_join(lines, near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    sure = sketched.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))


def _counts(text: str) -> Column:
    """``n`` lines with a word, and their ``chars``."""
    all_lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    return let(all_lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.aggregate(ls, F.lit(0).cast("long"), lambda s, x: s + F.length(F.btrim(x, F.lit(_BLANK)))).alias("chars")))


def _carried_lines(docs: DataFrame, text: str, site: str, min_sites: int, mostly: DataFrame, spread: DataFrame) -> DataFrame:
    """``h1, h2`` of the spread lines that texts outside ``mostly`` carry on ``min_sites`` sites."""
    t1, t2 = _key(F.col(text))
    keyed = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"), F.col(site).alias("site"))
    others = split_join(keyed, mostly, ["t1", "t2"], "left_anti")
    sites = split_join(_lines(others, "text", "site"), spread, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    return sites.where(F.col("sites") >= min_sites).select("h1", "h2")


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, most_share: float = 0.5, prefix: str = "") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the new columns ``n_lines`` (lines with a
    word) and ``n_removed``.

    Lines are split at U+000A and compared without surrounding white space; lines without a word are
    never removed. A line on ``min_sites`` sites is spread, and a document loses its spread lines. Where
    they hold over ``most_share`` of its characters, the document may itself be what is copied rather than a
    carrier of boilerplate: it loses those that stand on ``min_sites`` sites in documents that aren't mostly spread
    lines, and keeps those that only such documents, exact or near copies, bring to so many (near-duplicate
    removal keeps one of these). The result depends on the text and the corpus only, so repeated rows are
    treated alike; a null text stays null, a text without spread lines stays byte for byte, a null site
    counts as one site, an empty table stays empty, and extra columns stay, whatever their names (clashing new names are
    an error; use ``prefix``). One very long text is one row's work; its lines spread over tasks.
    """
    refuse(docs.columns, [prefix + "n_lines", prefix + "n_removed"])
    spread = written(spread_lines(docs, text, site, min_sites))
    # Copies of a text give the same places: they are combined before the shuffle, so each text has each place once.
    hits = split_join(_lines(docs, text, None), spread, ["h1", "h2"])
    hits = written(hits.groupBy("t1", "t2", "pos").agg(*[F.first(c).alias(c) for c in ("chars", "h1", "h2")]))
    share = hits.groupBy("t1", "t2").agg(F.sum("chars").alias("spread"))

    t1, t2 = _key(F.col(text))
    keyed = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    mostly = split_join(keyed, written(share), ["t1", "t2"]).where(F.col("spread") > most_share * _counts("text")["chars"])
    mostly = written(mostly.select("t1", "t2").distinct())
    carried = written(_carried_lines(docs, text, site, min_sites, mostly, spread))
    theirs = split_join(split_join(hits, mostly, ["t1", "t2"], "left_semi"), carried, ["h1", "h2"], "left_semi")
    cut = split_join(hits, mostly, ["t1", "t2"], "left_anti").unionByName(theirs)

    n1, n2, places, counts = (fresh(docs.columns, x) for x in ("t1", "t2", "places", "counts"))
    found = written(cut.groupBy(F.col("t1").alias(n1), F.col("t2").alias(n2)).agg(F.collect_list("pos").alias(places)))
    weight = found.agg(F.coalesce(F.sum(F.size(places) + 3), F.lit(0))).first()[0]
    joined = split_join(docs.withColumns({n1: t1, n2: t2}), found, [n1, n2], "left", most=SMALL_PLACES if weight <= SMALL_PLACES else 0)
    joined = joined.withColumn(counts, _counts(text))
    keep = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(places)), lambda i: F.get(ls, i))
    cleaned = F.when(F.col(places).isNotNull(), let(F.split(F.col(text), "\n"), lambda ls: F.array_join(keep(ls), "\n"))).otherwise(F.col(text))
    return joined.select(
        *[(cleaned.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns],
        F.col(counts)["n"].alias(prefix + "n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias(prefix + "n_removed"),
    )
