"""Periodic runs, Merkle manifests and the embedding join against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w):
    """All (start, length, smallest period) by comparing words p apart, for each p."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        at = 0
        while at + p < len(w):
            end = at
            while end + p < len(w) and w[end] == w[end + p]:
                end += 1
            if end + p - at >= max(6, 4 * p):
                found.setdefault((at, end + p - at), p)
            at = max(end, at) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def looped_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts(seed=5):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "A a " * 9, "x y z " * 40 + "q", "a b a b a b c a b a b a b a b d d d d d d", "é é " * 7]
    for k in range(60):
        w = [rng.choice("abcde"[: 2 + k % 4]) for _ in range(rng.randint(1, 120))]
        for _ in range(k % 4):
            at, block = rng.randrange(len(w) + 1), [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
            w[at:at] = (block * 9)[: rng.randint(1, 9 * len(block))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out + ["w " * 30_000, "u v w x y " * 4_000 + "u v"]


def test_periodic_runs_match_brute_force(spark):
    from evidentia.llm.periodic_runs import find_runs

    data = [(i, t) for i, t in enumerate(texts()[:-2])] * 2 + [(900, texts()[-2]), (901, texts()[-1]), (None, "k k k k k k k")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("start", F.lit("extra")).repartition(3)
    got = find_runs(df)
    assert got.columns == ["doc_id", "text", "start", "n_words", "runs", "collapsed"] and got.count() == len(data)
    for r in got.collect():
        w = WORD.findall(r["text"] or "")
        want = [(0, len(w), {900: 1, 901: 5}[r["doc_id"]])] if r["doc_id"] in (900, 901) else plain_runs(w)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == want, r["text"]
        assert r["collapsed"] == (None if r["text"] is None else " ".join(x for i, x in enumerate(w) if i not in gone))
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        find_runs(df.withColumn("N_Words", F.lit(1)))
    assert "p_runs" in find_runs(df.withColumn("runs", F.lit(1)), prefix="p_").columns


def test_periodic_runs_in_blocks_give_the_same(monkeypatch):
    from evidentia.llm import periodic_runs

    rng = np.random.default_rng(1)
    word, begin = rng.integers(0, 2, 3000), np.array([0, 0, 700, 701, 3000])
    whole = [x.tolist() for x in periodic_runs.find(word, begin)]
    monkeypatch.setattr(periodic_runs, "PLACES", 50)
    assert [x.tolist() for x in periodic_runs.find(word, begin)] == whole and whole[0]


def test_periodic_runs_query_matches_brute_force(spark, tmp_path):
    from evidentia.llm.queries import op11_periodic_runs

    rng = random.Random(2)
    body = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 90)))
    data = [(i, t) for i, t in enumerate(texts())] + [(1000 + i, body()) for i in range(150)] + [(None, "a b c d"), (1000, "n n")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for i, t in data:
        w = looped_words(i, WORD.findall(t or ""))
        runs = [(0, len(w), 1 if len(set(w)) == 1 else 5)] if len(w) > 9_000 and w == WORD.findall(t) else plain_runs(w)
        gone = {x for s, n, p in runs for x in range(s + p, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """Root, and each leaf's siblings as (own place, run) up to it."""
    level, paths, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(place):
            paths[i].append((at % 3, level[at // 3 * 3 : at // 3 * 3 + 3]))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        place = [at // 3 for at in place]
    return level[0], paths


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize(("part_rows", "climb"), [(10_000, 5), (7, 1), (4, 2), (1, 1)])
def test_merkle_manifest_matches_brute_force(spark, tmp_path, part_rows, climb, monkeypatch):
    from evidentia.llm import merkle
    from evidentia.llm.merkle import checked, manifest, row_digest

    monkeypatch.setattr(merkle, "SMALL_PROOFS", 10_000 if climb == 5 else 0)
    rng = random.Random(4)
    n = 300 if part_rows > 3 else 60
    data = [(i, rng.choice(["é", "z", "Z"]), "en", 3, rng.choice(["a\nb", "c", "\n", None, ""])) for i in rng.sample(range(10**6), n // 3)]
    data += [(i, "hot", None, None, f"t\n{i}") for i in rng.sample(range(10**6), n)] + [(5, None, "de", 1, "x"), (None, None, "de", 1, "y\n"), (None, "one", None, None, None)]
    data += [(7, "hot", "en", 2, "same\n")] * 20
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").withColumn("ROOT", F.lit(1)).withColumn("grp", F.lit("g")).repartition(5)
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    low = row_digest([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in cols])
    groups = collections.defaultdict(list)
    for r in data:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), sha("".join(map(field, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {g: (sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])])) for g in names}
    root, tops = tree([made[g][1] for g in names])
    want = collections.Counter()
    for g, top in zip(names, tops, strict=True):
        rows, sub, paths = made[g]
        for (_, _, leaf, shown, doc), path in zip(rows, paths, strict=True):
            folded, siblings = shown, ""
            for own, run in path + top:
                siblings += "".join(run[:own] + run[own + 1 :])
                folded = sha("".join([*run[:own], folded, *run[own + 1 :]]))
            want[(doc, leaf, sub, root, sha(siblings), folded, folded == root)] += 1
    out = checked(manifest(df, cols, presented=low, part_rows=part_rows, climb=climb)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(tuple(r) for r in out.collect()) == want
    assert manifest(df.limit(0), cols).count() == 0
    lone = checked(manifest(df.where("source = 'one'"), cols)).first()
    assert lone["root"] == lone["leaf"] and lone["verified"] and lone["proof_sha256"] == sha("")


def vectors(seed=6, n=260, size=12):
    """Unit-like vectors in near groups, chains, copies, scaled copies, odd rows, and one very common vector."""
    rng = np.random.default_rng(seed)
    out, centres = [], rng.normal(size=(8, size))
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=size) * rng.choice([0.05, 0.3, 0.6]) if i % 3 else rng.normal(size=size)
        out.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 17 else None))
    chain = [[float(np.cos(t)), float(np.sin(t))] + [0.0] * (size - 2) for t in np.arange(0, 3, 0.3)]
    out += [(400 + k, v, 7) for k, v in enumerate(chain)] + [(500 + k, out[1][1], out[1][2]) for k in range(70)]
    out += [(600, [3 * x for x in out[1][1]], out[1][2]), (601, None, 1), (602, [], 1), (603, [0.0] * size, 1), (604, [None] + [1.0] * (size - 1), 1), (605, [float("nan")] * size, 1), (606, [float("inf")] + [0.0] * (size - 1), 1)]
    out += [(607, [1.0, 0.0], 1), (608, [2.0, 0.0], 1), (609, [1e-30, 1e-30], 1), (None, out[1][1], out[1][2]), (None, [9.0] * 5, 2), (out[2][0], out[2][1], out[2][2])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "stretch": 2, "dimensions": 3, "sample": 40}, {"block": 5, "stretch": 1, "dimensions": 1}])
def test_embedding_join_matches_brute_force(spark, sizes, monkeypatch):
    from evidentia.llm import embedding_join as e

    if sizes:
        monkeypatch.setattr(e, "LEAF", 4)
        monkeypatch.setattr(e, "SMALL_BOXES", 0)
    data = vectors()
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in data]
    n, near = len(data), collections.defaultdict(set)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if good else None for (_, v, _), good in zip(data, ok, strict=True)]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93:
                near[i].add(j)
                near[j].add(i)
    want, seen = collections.Counter(), {}
    for i in range(n):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in near[todo.pop()] - part:
                    part.add(j)
                    todo.append(j)
            ids = [data[j][0] for j in part if data[j][0] is not None]
            seen |= {j: min(ids, default=None) for j in part}
        want[data[i][0], len(near[i]), seen[i], data[i][0] == seen[i]] += 1
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("UID", F.lit(1)).withColumn("k1", F.lit("x")).repartition(4)
    got = e.near_vectors(df, **sizes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert e.near_vectors(df.limit(0)).count() == 0
