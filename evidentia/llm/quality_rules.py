"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACES, fresh, let, refuse

# Frequent words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all "
    "le la les de des du et un une en que qui dans pour pas sur par est au ce il elle se son "
    "el los las del y es con para una no su al lo como más pero sus "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
).split()


class Rule(NamedTuple):
    """A document fails where ``100 * numerator`` leaves [low, high] times ``denominator``."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


#: Length, symbol, stop-word and line rules over the columns of ``statistics``.
RULES = (
    Rule("too_long_words", "word_chars", "n_words", None, 1500),
    Rule("too_short_words", "word_chars", "n_words", 200, None),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("marks", "n_marks", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 6, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)


def stop_words(t: Column) -> Column:
    """Words of the text ``t`` that are stop words in lower case and without marks at their end."""
    plain = F.split(F.regexp_replace(F.lower(t), "[.,;:!?]+(?=[\\x20\\x09-\\x0D]|\\z)", ""), SPACES)
    return F.size(F.filter(plain, lambda x: x.isin(STOP_WORDS)))


def _repeated(words: Column) -> Column:
    """Words covered by 3-word windows found twice or more: windows are sorted with their places, equal neighbours mark both."""
    n = F.size(words)

    def covered(p: Column) -> Column:
        m = F.size(p)
        hit = lambda x, k: (F.get(p, k - 1)["w"] == x["w"]) | (F.get(p, k + 1)["w"] == x["w"])
        places = F.sort_array(F.transform(F.filter(p, lambda x, k: F.coalesce(hit(x, k), F.lit(False))), lambda x: x["i"]))
        return F.when(m < 2, F.lit(0)).otherwise(
            F.aggregate(
                places,
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
                lambda s: s["n"],
            )
        )

    window = lambda x, i: F.struct(F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), window)), covered))


def statistics(text: Column) -> Column:
    """A struct of counts (long) over one text; null counts as empty.

    Words are runs outside U+0020 and U+0009 to U+000D; lines are split at U+000A.
    """
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    having = lambda chars: F.regexp_count(t, F.lit(chars)).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    return let(
        let(words, of_words),
        lambda a: let(
            lines,
            lambda ls: F.struct(
                a["n_words"].alias("n_words"),
                a["word_chars"].alias("word_chars"),
                having("[#*$%&|<>]").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                a["n_repeat_words"].alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                having("[!?]").alias("n_marks"),
                stop_words(t).cast("long").alias("n_stop_words"),
            ),
        ),
    )


def compile_rules(rules: tuple[Rule, ...], s: Column) -> Column:
    """The names of the rules that fail, as one array column; a ratio over zero passes."""
    failed = []
    for r in rules:
        num, den = 100.0 * s[r.numerator], s[r.denominator]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (num < r.low * den)
        if r.high is not None:
            bad = bad | (num > r.high * den)
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``failed_rules`` and ``kept``.

    One row out for each row in: repeated rows stay, a null or empty text has zero words and so fails,
    and every extra column is kept. ``prefix`` is put before the new names where they would clash
    with columns of ``docs``; a clash is an error rather than a silent overwrite. The projection is
    row-local: nothing is shuffled, so hot sources or groups of copies have no effect.
    """
    made = [*(f for f in _FIELDS), "base_failed", "failed_rules", "kept"]
    refuse(docs.columns, [prefix + x for x in made])
    hidden = fresh(docs.columns, "stats")
    with_stats = docs.withColumn(hidden, statistics(F.col(text)))
    s = F.col(hidden)
    base = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    bad = compile_rules(rules, s)
    return with_stats.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[s[f].alias(prefix + f) for f in _FIELDS],
        base.alias(prefix + "base_failed"),
        bad.alias(prefix + "failed_rules"),
        (~base & (F.size(bad) == 0)).alias(prefix + "kept"),
    )


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_stop_words")
