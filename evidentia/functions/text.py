"""Text column functions. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the reference behaviour defines it, words, and first words of a question.
SPACES = "\\s\\u000B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACE = f"[{SPACES}]+"
WORD = "[\\p{L}\\p{N}]+(?:['’\\-][\\p{L}\\p{N}]+)*"
QUESTION_WORDS = "what when where which who whom whose why how is are was were can could do does did will would should may might have has had".split()
ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "amp": "&"}


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null stays null."""
    return F.btrim(F.regexp_replace(x, SPACE, " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(WORD)).cast("long")


def sentences(x: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space that have a letter or number."""
    pieces = F.transform(F.split(F.coalesce(x, F.lit("")), "(?<=[.!?])" + SPACE), collapse)
    return F.filter(pieces, lambda s: s.rlike("[\\p{L}\\p{N}]"))


def decode_entities(x: Column) -> Column:
    """The six named references (numeric ones are decoded where HTML is parsed)."""
    for name, char in ENTITIES.items():
        x = F.regexp_replace(x, f"(?i)&{name};", char)
    return x


def question(x: Column) -> Column:
    """The readable question in ``x``, or null: at most 220 characters, 2 to 30 words, a question word first."""
    q = F.regexp_replace(F.regexp_replace(collapse(decode_entities(x)), "<[^>]*>", ""), SPACE + "\\?", "?")
    n = word_count(q)
    first = "(?i)^(?:" + "|".join(QUESTION_WORDS) + ")(?![A-Za-z0-9_])"
    return F.when(q.endswith("?") & (F.length(q) <= 220) & n.between(2, 30) & q.rlike(first), q)


def questions(x: Column) -> Column:
    plain = F.regexp_replace(collapse(decode_entities(F.coalesce(x, F.lit("")))), "<[^>]*>", "")
    return F.array_compact(F.transform(sentences(plain), question))


def distinct_folded(xs: Column) -> Column:
    """Strings distinct without regard to case, first spelling and first place kept."""
    seen = F.transform(xs, F.lower)
    return F.filter(xs, lambda x, i: (F.array_position(seen, F.lower(x)) - 1) == i)


def terms(x: Column) -> Column:
    """Distinct lower-case letter and number runs of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)")), lambda t: F.length(t) >= 3))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def around(x: Column, at: Column, size: Column, before: int, after: int) -> Column:
    """What stands at ``at`` (from 1) with some characters around it, collapsed."""
    start = F.greatest(at - before, F.lit(1))
    return collapse(F.substring(x, start, at - start + size + after))


def words(alternatives: str, ignore_case: bool = True) -> str:
    """A pattern for ``alternatives`` between ASCII word boundaries; each begins and ends with a letter or digit."""
    return f"{'(?i)' if ignore_case else ''}(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def boundary(alternatives: str, ignore_case: bool = True) -> str:
    """A pattern for whole words with ASCII word boundaries, the same in Java and RE2."""
    return f"{'(?i)' if ignore_case else ''}(?:^|[^A-Za-z0-9_])(?:{alternatives})(?:$|[^A-Za-z0-9_])"


def stable_number(x: Column) -> Column:
    """A number's text for hashing: plain decimal, without trailing zeros."""
    plain = F.format_string("%.12f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")


def sha(*parts: Column) -> Column:
    """sha256 of the parts joined by U+001F; null parts are empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
