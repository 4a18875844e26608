"""Quality classifier: rules cut from shallow trees, weighted by a lasso logistic fit, compiled to columns.

Training sees a bounded sample of labelled rows (``max_rows``); scoring is one projection of built-in
functions over every row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACES, fold_of, fresh, let, refuse
from evidentia.llm.quality_rules import stop_words

_BLANK = " \t\n\x0b\x0c\r"
# Characters that each count takes in; upper case means letters of English and Western European alphabets.
_UPPER, _DIGITS, _POINTS, _MARKS, _SYMBOLS = "[A-ZÀ-ÏÑ-ÖØ-Ý]", "[0-9]", "[.,;:]", "[!?]", "[#*$%&|<>~^=_{}\\[\\]\\\\@]"
FEATURES = ("n_words", "word_length", "symbols", "marks", "stops", "upper", "digits", "points", "repeated_lines", "line_words", "distinct")


def features(text: Column) -> Column:
    """A struct of doubles over one text; null counts as empty and gives zeros."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(_BLANK))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    having = lambda chars: F.regexp_count(t, F.lit(chars)).cast("double")

    def made(w: Column, ls: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))

        def counted(chars: Column) -> Column:
            some = F.greatest(chars, F.lit(1))
            values = (
                F.size(w), chars / n, having(_SYMBOLS) / n, having(_MARKS) / n, stop_words(t) / n, having(_UPPER) / some, having(_DIGITS) / some, having(_POINTS) / n,
                F.lit(1) - F.size(F.array_distinct(ls)) / F.greatest(F.size(ls), F.lit(1)), F.size(w) / F.greatest(F.size(ls), F.lit(1)),
                F.size(F.array_distinct(w)) / n,
            )
            return F.struct(*[v.cast("double").alias(k) for k, v in zip(FEATURES, values, strict=True)])

        return let(F.length(F.array_join(w, "")), counted)

    return let(words, lambda w: let(lines, lambda ls: made(w, ls)))


class Rule(NamedTuple):
    """A conjunction of (feature, is_above, threshold), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: Column) -> Column:
        """The probability of label 1 from a ``features`` struct."""
        total = F.lit(self.intercept)
        for r in self.rules:
            hit = F.lit(True)
            for name, above, at in r.terms:
                hit = hit & ((x[name] > at) if above else (x[name] <= at))
            total = total + F.when(hit, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], depth: int) -> tuple[list[tuple], np.ndarray]:
    """One second-order regression tree: the paths to its nodes, and each row's value."""
    paths, value = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-3, None)
        for j, cuts in enumerate(edges if left else []):
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, x[rows, j], side="left")  # bin b: cuts[b-1] < value <= cuts[b]
            gs, hs = (np.cumsum(np.bincount(at, v[rows], len(cuts) + 1))[:-1] for v in (grad, hess))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 0.5) | (h - hs < 0.5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, float(cuts[k])))
        if path:
            paths.append(path)
        if best[1] is None:
            value[rows] = g / (h + 1)
            return
        j, cut = best[1]
        low = x[rows, j] <= cut
        split(rows[low], (*path, (j, False, cut)), left - 1)
        split(rows[~low], (*path, (j, True, cut)), left - 1)

    split(np.arange(len(x)), (), depth)
    return paths, value


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 24, depth: int = 3, penalty: float = 2e-3, steps: int = 600) -> Model:
    """Boosted trees give the rules; proximal gradient steps on the logistic loss with an L1 penalty weigh them.

    A row counts ``weight`` times. Without rows, or with one class only, the model is a constant.
    """
    n = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    rate = float(np.clip(np.average(y, weights=n), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Model(base, ())
    share = n / n.sum()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    margin, seen = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, value = _grow(x, n * (y - p), n * p * (1 - p), edges, depth)
        margin += 0.3 * value
        for path in paths:
            seen.setdefault(tuple(sorted(path)), None)
    rules = list(seen)
    hits = np.stack([np.all([(x[:, j] > c) == above for j, above, c in r], axis=0) for r in rules], axis=1).astype(float)
    keep = (hits.min(0) == 0) & (hits.max(0) == 1)
    hits, rules = hits[:, keep], [r for r, k in zip(rules, keep, strict=True) if k]
    w, b, z, zb, t = np.zeros(len(rules)), base, np.zeros(len(rules)), base, 1.0
    rate_of_step = 4 / np.linalg.norm(np.column_stack([hits, np.ones(len(y))]) * np.sqrt(share)[:, None], 2) ** 2
    for _ in range(steps):
        r = share * (1 / (1 + np.exp(-(hits @ z + zb))) - y)
        to = z - rate_of_step * (hits.T @ r)
        new, new_b = np.sign(to) * np.maximum(np.abs(to) - rate_of_step * penalty, 0), zb - rate_of_step * r.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    named = [Rule(tuple((FEATURES[j], above, c) for j, above, c in r), float(k)) for r, k in zip(rules, w, strict=True) if k]
    return Model(float(b), tuple(named))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Model:
    """A model of ``label`` (0 or 1) from rows outside the held-out fold (crc32 of the id, mod 5, is 0).

    Equal statistics with equal labels are one row of weight 1 + ln(times), so copies of a text are one draw, and a text that
    is copied without end doesn't drown the others. ``max_rows`` labelled ids are drawn by a hash from all of them, and ``max_rows`` weighted rows
    by a hash of their values from what their documents give; both bounds are exact, so the driver holds no more. Null labels
    and ids are left out; an id with both labels, or with several documents, counts with each. The drawn ids
    are bounded, so they are broadcast, and statistics are computed for their documents only.
    """
    number, y = fresh(docs.columns, "id"), fresh(docs.columns, "y")
    known = labels.select(F.col(doc_id).alias(number), F.col(label).cast("double").alias(y))
    known = known.where(F.col(number).isNotNull() & F.col(y).isin(0.0, 1.0) & (fold_of(F.col(number)) != 0)).distinct()
    known = known.orderBy(F.xxhash64(number), number, y).limit(max_rows)
    rows = docs.join(F.broadcast(known), F.col(doc_id) == F.col(number)).select(features(F.col(text)).alias("x"), F.col(y).alias("y"))
    rows = rows.groupBy("x", "y").agg((1 + F.log(F.count("*"))).alias("n")).orderBy(F.xxhash64("x", "y"), "x", "y").limit(max_rows)
    got = rows.select("x.*", "y", "n").toPandas().sort_values([*FEATURES, "y"], ignore_index=True)
    return fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float), got["n"].to_numpy(float))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (1 where the score reaches ``threshold``).

    Every row is scored, null and empty texts too; repeated rows and extra columns stay, an empty table
    stays empty, and new names that exist already are an error (use ``prefix``).
    """
    refuse(docs.columns, [prefix + "score", prefix + "predicted"])
    x = fresh(docs.columns, "features")
    scored = docs.withColumn(x, features(F.col(text))).withColumn(prefix + "score", model.score(F.col(x))).drop(x)
    return scored.withColumn(prefix + "predicted", (F.col(prefix + "score") >= threshold).cast("int"))
