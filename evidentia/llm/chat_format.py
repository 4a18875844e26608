"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks, then turns are rendered.

States are the roles, observations the lines of all texts. A line shows a speaker mark (its row's role
column, or where that names nobody a mark such as ``User:`` before the line) and features of its own;
steps differ between lines that open a row or carry a mark and lines that go on. Rows are sorted into
blocks of bounded size, so a conversation of any length spreads over blocks: each block is summed up as
the max-plus product of its first conversation's steps, sums of many blocks compose to one, a scan over
these fixes the states at their borders, then within each at its blocks' borders, and every block is
decoded between its borders. That is exactly Viterbi over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import release, written
from evidentia.ship import ship

ROLES = ("system", "user", "assistant")
K = len(ROLES)
# Names of speakers, by role.
NAMES = {
    "system": ("system", "developer", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a"),
}
#: Rows and bytes of text in a block, and blocks that are summed up as one.
BLOCK_ROWS, BLOCK_BYTES, SUPER = 20_000, 16 << 20, 512
#: Sizes of the features: mark (one more for none), length, asks, lines of the row (one more where a line goes on).
WIDTHS = (K + 1, 16, 2, 5)
#: A step within a row counts so many times as one that stays, before any is seen.
STAYS = 20.0
_ANY = "(" + "|".join(n for v in NAMES.values() for n in v) + ")"
_MARK = re.compile(rf"\s*(?:(?:#{{1,6}}\s*)?(?:\*\*|\[)?{_ANY}(?:\*\*|\])?\s*:(?:\*\*)?\s*|#{{1,6}}\s*{_ANY}\s*$|\[{_ANY}\]\s*|<\|(?:im_start\|>)?{_ANY}(?:\|>)?\s*$)", re.IGNORECASE)
_CODE = {n: k for k, r in enumerate(ROLES) for n in NAMES[r]}
_TURN_MARK = re.compile(r"<(\\*)\|im_")


def given_role(role: Column | None) -> Column:
    """0 to 2: the role that the role column names; 3: none."""
    out = F.lit(K)
    if role is not None:
        name = F.lower(F.btrim(role.cast("string")))
        for k, r in enumerate(ROLES):
            out = F.when(name.isin(*NAMES[r]), F.lit(k)).otherwise(out)
    return out.cast("int")


def speaker(line: str) -> tuple[int, int]:
    """The role of the mark before a line (3: none), and where the line goes on after it."""
    m = _MARK.match(line)
    return (_CODE[next(g for g in m.groups() if g).lower()], m.end()) if m else (K, 0)


class Model(NamedTuple):
    """Log probabilities: of first roles, of steps (within a row, and to a line that opens one or has a mark), and of each feature's values by role."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def scores(self, features: list[np.ndarray], given: np.ndarray) -> np.ndarray:
        """Each line's score by role; a line whose row names its speaker can only be that one's."""
        free = sum(e[:, f] for e, f in zip(self.emit, features, strict=True)).T
        return np.where((given[:, None] == K) | (given[:, None] == np.arange(K)), free, -np.inf)


_ROW = ["conv", "at", "text", "given"]
_SORTED = "conv long, at long, text string, given int, block int, seq long"


def _sorted_blocks(lines: DataFrame, conv: str, order: str, text: str, role: str | None) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    seen = lines.select(F.col(conv).cast("long").alias("conv"), F.col(order).cast("long").alias("at"), t.alias("text"), given_role(F.col(role) if role else None).alias("given"))
    size = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-size["b"] // BLOCK_BYTES))
    keys = ["conv", "at", "tie", "line"]
    seen = seen.withColumn("tie", F.xxhash64("text", "given")).withColumn("line", F.monotonically_increasing_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([*(b.column(c) for c in _ROW), pa.array([block] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64())], names=[*_ROW, "block", "seq"])
            seq += n

    return written(seen.repartitionByRange(int(blocks), *keys).sortWithinPartitions(*keys).mapInArrow(number, _SORTED))


class _Block:
    """Rows of a block in order, and their lines: row, conversation's start, features, kind of step, where the text goes on after a mark."""

    def __init__(self, group: pa.Table):
        self.table = group.take(pa.array(np.argsort(np.asarray(group.column("seq")), kind="stable"))).combine_chunks()
        ids = self.table.column("conv")
        values, gone = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
        new_row = np.concatenate([[True], (values[1:] != values[:-1]) | (gone[1:] != gone[:-1])])
        lists = pc.split_pattern(self.table.column("text").combine_chunks().cast(pa.large_string()), "\n")
        count = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        self.lines, self.row = lists.flatten(), np.repeat(np.arange(len(count)), count)
        opens = np.zeros(len(self.row), bool)
        opens[np.cumsum(count) - count] = True
        self.new = opens & new_row[self.row]
        self.opens_row = opens
        self.given = given = np.asarray(self.table.column("given"))[self.row]
        mark, self.cut = given.copy(), np.zeros(len(self.row), np.int64)
        for i in np.flatnonzero(given == K).tolist():
            mark[i], self.cut[i] = speaker(self.lines[i].as_py())
        length = np.asarray(pc.utf8_length(self.lines), dtype=np.int64)
        asks = np.asarray(pc.match_substring(self.lines, "?"), dtype=np.int64)
        self.features = [mark, np.minimum(np.log2(length + 1).astype(np.int64), WIDTHS[1] - 1), asks, np.where(opens, np.minimum(count[self.row] - 1, 3), 4)]
        self.kind = (opens | ((given == K) & (mark < K))).astype(np.int64)
        self.first, self.last, self.block = ids[0].as_py(), ids[-1].as_py(), self.table.column("block")[0].as_py()
        self.cuts = np.append(np.flatnonzero(self.new), len(self.new))
        release()


def fit(blocks: DataFrame) -> Model:
    """Counts over all lines with a mark, plus one each; steps across a block's border are left out."""

    def count(group: pa.Table) -> pa.Table:
        b = _Block(group)
        role = b.features[0]
        known = role < K
        both = known[1:] & known[:-1] & ~b.new[1:]
        parts = [("step", (b.kind[1:][both] * K + role[:-1][both]) * K + role[1:][both]), ("start", role[b.new & known])]
        parts += [(f"emit{i}", role[known] * WIDTHS[i] + f[known]) for i, f in enumerate(b.features)]
        out = [(name, int(c), float(n)) for name, codes in parts for c, n in enumerate(np.bincount(codes)) if n]
        return pa.table({"what": pa.array([x[0] for x in out], pa.string()), "code": pa.array([x[1] for x in out], pa.int32()), "n": pa.array([x[2] for x in out], pa.float64())})

    rows = blocks.groupBy("block").applyInArrow(count, "what string, code int, n double").groupBy("what", "code").agg(F.sum("n").alias("n")).collect()
    tables = {"start": np.ones(K), "step": np.ones(2 * K * K)} | {f"emit{i}": np.ones(K * w) for i, w in enumerate(WIDTHS)}
    for r in rows:  # at most one for each cell of the model
        tables[r["what"]][r["code"]] += r["n"]
    rate = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    emit = [rate(tables[f"emit{i}"].reshape(K, w)) for i, w in enumerate(WIDTHS)]
    # A line without a mark says nothing about its role.
    emit[0][:, K] = emit[0][:, K].mean()
    step = tables["step"].reshape(2, K, K)
    step[0] += STAYS * np.eye(K)
    return Model(rate(tables["start"]), rate(step), emit)


def fit_roles(lines: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", role: str | None = "role") -> Model:
    """A model of the marked lines of ``lines``, for ``format_chats`` over others."""
    ship(lines.sparkSession)
    return fit(_sorted_blocks(lines, conv, order, text, role))


class Sums(NamedTuple):
    """Neighbouring lines in short: the first and last conversation, whether they are one, the best score of the
    first one's lines by the state before and the last state (head), and of the last one's by its last state (tail)."""

    first: int | None
    last: int | None
    single: bool
    head: np.ndarray
    tail: np.ndarray


def _product(model: Model, scores: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = np.where(np.eye(K, dtype=bool), 0.0, -np.inf)
    for s, k in zip(scores, kind.tolist(), strict=True):
        out = (out[:, :, None] + model.step[k][None, :, :]).max(1) + s
    return out


def sums_of(model: Model, b: _Block) -> Sums:
    scores, cuts = model.scores(b.features, b.given), b.cuts
    head = _product(model, scores[: cuts[1]], b.kind[: cuts[1]])
    start = model.start + scores[cuts[-2]]
    tail = (start[:, None] + _product(model, scores[cuts[-2] + 1 :], b.kind[cuts[-2] + 1 :])).max(0)
    return Sums(b.first, b.last, len(cuts) == 2, head, tail)


def joined(a: Sums, b: Sums) -> Sums:
    """The sum of two neighbours; associative."""
    meets = a.last == b.first
    head = (a.head[:, :, None] + b.head[None, :, :]).max(1) if meets and a.single else a.head
    tail = (a.tail[:, None] + b.head).max(0) if meets and b.single else b.tail
    return Sums(a.first, b.last, meets and a.single and b.single, head, tail)


class Border(NamedTuple):
    """Around some lines: best scores by the state before them (None: a conversation starts), that state, the last
    line's state (None: free), and whether the last conversation ends there."""

    forward: np.ndarray | None
    before: int | None
    last: int | None
    ends: bool


def borders(sums: list[Sums], around: Border) -> list[Border]:
    """The border of each of the neighbours that ``around`` surrounds."""
    n = len(sums)
    meets = [around.forward is not None if i == 0 else sums[i - 1].last == sums[i].first for i in range(n)]
    entering: list[np.ndarray | None] = []
    forward = around.forward
    for i, s in enumerate(sums):
        entering.append(forward if meets[i] else None)
        forward = (forward[:, None] + s.head).max(0) if meets[i] and s.single else s.tail
    last: list[int | None] = [None] * n
    before: list[int | None] = [None] * n
    last[-1] = around.last
    for i in range(n - 1, -1, -1):
        if not meets[i]:
            continue
        if sums[i].single:
            if last[i] is None:
                last[i] = int(np.argmax((entering[i][:, None] + sums[i].head).max(0)))
            back = entering[i] + sums[i].head[:, last[i]]
        else:
            back = (entering[i][:, None] + sums[i].head).max(1)
        before[i] = int(np.argmax(back)) if i else around.before
        if i:
            last[i - 1] = before[i]
    return [Border(entering[i], before[i], last[i], around.ends if i + 1 == n else not meets[i + 1]) for i in range(n)]


_SUMS = "block int, super int, first long, last long, single boolean, head array<double>, tail array<double>"
_BORDER = "block int, before int, last int, ends boolean"


def _row_of(s: Sums, block: int, over: int) -> dict:
    return {"block": [block], "super": [over], "first": [s.first], "last": [s.last], "single": [s.single], "head": [s.head.ravel().tolist()], "tail": [s.tail.tolist()]}


def _as_table(columns: dict) -> pa.Table:
    kinds = {"block": pa.int32(), "super": pa.int32(), "first": pa.int64(), "last": pa.int64(), "single": pa.bool_(), "head": pa.list_(pa.float64()), "tail": pa.list_(pa.float64()), "before": pa.int32(), "ends": pa.bool_()}
    return pa.table({k: pa.array(v, pa.int32() if k == "last" and "before" in columns else kinds[k]) for k, v in columns.items()})


def _sums_in(rows: list[dict]) -> list[Sums]:
    rows.sort(key=lambda r: r["block"])
    return [Sums(r["first"], r["last"], r["single"], np.array(r["head"]).reshape(K, K), np.array(r["tail"])) for r in rows]


def _borders(blocks: DataFrame, model: Model, over: int) -> DataFrame:
    """``block, before, last, ends``: the driver sees one row for each ``over`` blocks."""

    def of_block(group: pa.Table) -> pa.Table:
        b = _Block(group)
        return _as_table(_row_of(sums_of(model, b), b.block, b.block // over))

    def of_many(group: pa.Table) -> pa.Table:
        sums = _sums_in(group.to_pylist())
        total = sums[0]
        for s in sums[1:]:
            total = joined(total, s)
        at = group.column("super")[0].as_py()
        return _as_table(_row_of(total, at, at))

    each = written(blocks.groupBy("block").applyInArrow(of_block, _SUMS))
    rows = [r.asDict() for r in each.groupBy("super").applyInArrow(of_many, _SUMS).collect()]
    found = borders(_sums_in(rows), Border(None, None, None, True)) if rows else []
    around = {r["super"]: b for r, b in zip(rows, found, strict=True)}

    def within(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        got = borders(_sums_in(rows), around[rows[0]["super"]])
        return _as_table({"block": [r["block"] for r in rows], "before": [b.before for b in got], "last": [b.last for b in got], "ends": [b.ends for b in got]})

    return each.groupBy("super").applyInArrow(within, _BORDER)


def viterbi(model: Model, scores: np.ndarray, kind: np.ndarray, starts: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
    """The best states of all lines; conversations begin at ``starts`` and are worked on side by side.

    ``before`` is the state before the first line (None: a conversation starts there), ``last`` that of the last line.
    """
    sizes = np.diff(np.append(starts, len(scores)))
    by = np.argsort(-sizes, kind="stable")
    begin, left = starts[by], -sizes[by]
    best = model.start + scores[begin]
    at = int(np.flatnonzero(begin == 0)[0])
    if before is not None:
        best[at] = model.step[kind[0]][before] + scores[0]
    back = np.zeros((len(scores), K), np.int8)
    longest = int(sizes.max())
    for t in range(1, longest):
        many = int(np.searchsorted(left, -t))
        spot = begin[:many] + t
        ways = best[:many, :, None] + model.step[kind[spot]]
        back[spot] = ways.argmax(1)
        best[:many] = ways.max(1) + scores[spot]
    out = np.zeros(len(scores), np.int64)
    ends = begin - left - 1
    out[ends] = best.argmax(1)
    if last is not None:
        out[-1] = last
    for t in range(longest - 1, 0, -1):
        spot = begin[: int(np.searchsorted(left, -t))] + t
        out[spot - 1] = back[spot, out[spot]]
    return out


def escape(text: str) -> str:
    """``text`` in which no turn mark can be read; ``parse`` undoes it."""
    return _TURN_MARK.sub(r"<\1\\|im_", text)


def parse(transcript: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a canonical transcript."""
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", transcript, re.DOTALL)
    return [(role, re.sub(r"<(\\*)\\\|im_", r"<\1|im_", body)) for role, body in turns]


_OUT = "conv long, at long, part int, role string, opens boolean, rendered string"


def format_chats(
    lines: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", role: str | None = "role", model: Model | None = None, over: int = SUPER
) -> DataFrame:
    """``conv, at, part, role, opens, rendered`` for every stretch of a row that one role speaks: whether a turn opens
    with it, and its part of the canonical transcript (joined in order, the parts of a conversation are its transcript).

    A row whose role column names a speaker is that role's, and its text stays as it is. In other rows each
    line may bear a mark of its own (``User:``, ``[bot]``, ``### Assistant``); the roles of lines come from marks,
    neighbours and features, so a whole transcript in one row falls into its turns, and a mark is cut where
    the line has got its role. Turn marks inside a text are escaped. The model is counted from all lines
    with a mark unless one is given. Rows are ordered by ``order``, then by content: null orders first,
    repeated rows stay, a null text is an empty line, null conversation ids are one conversation, other
    columns are not read, and an empty table gives no rows. A very long text is one row's work in memory.
    """
    ship(lines.sparkSession)
    blocks = _sorted_blocks(lines, conv, order, text, role)
    fitted = model or fit(blocks)

    def decode(group: pa.Table, about: pa.Table) -> pa.Table:
        b = _Block(group)
        before, last, ends = (about.column(c)[0].as_py() for c in ("before", "last", "ends"))
        state = viterbi(fitted, fitted.scores(b.features, b.given), b.kind, b.cuts[:-1], before, last)
        past = np.concatenate([[-1 if before is None else before], state[:-1]])
        turn = b.new | (state != past)
        if before is not None:
            turn[0] = state[0] != before
        text = b.lines.to_pylist()
        used = np.flatnonzero((b.cut > 0) & (b.features[0] == state))
        for i in used.tolist():
            text[i] = text[i][b.cut[i] :]
        bare = np.zeros(len(text), bool)
        bare[[i for i in used.tolist() if not text[i]]] = True
        begin = np.flatnonzero(b.opens_row | turn)
        stop = np.append(begin[1:], len(text))
        first_of_row = np.searchsorted(begin, np.flatnonzero(b.opens_row))
        part = np.arange(len(begin)) - np.repeat(first_of_row, np.diff(np.append(first_of_row, len(begin))))
        starts_conv = b.new.copy()
        starts_conv[0] = before is None
        closes = np.append(b.new[stop[:-1]], ends)
        rendered = []
        for i, j, done in zip(begin.tolist(), stop.tolist(), closes.tolist(), strict=True):
            body = escape("\n".join(text[i + 1 : j] if bare[i] and j - i > 1 else text[i:j]))
            shown = ("" if starts_conv[i] else "<|im_end|>\n") + f"<|im_start|>{ROLES[state[i]]}\n{body}" if turn[i] else "\n" + body
            rendered.append(shown + ("<|im_end|>\n" if done else ""))
        rows = pa.array(b.row[begin])
        return pa.table(
            {
                "conv": b.table.column("conv").take(rows), "at": b.table.column("at").take(rows), "part": pa.array(part, pa.int32()),
                "role": pa.array([ROLES[s] for s in state[begin].tolist()], pa.string()), "opens": pa.array(turn[begin]), "rendered": pa.array(rendered, pa.string()),
            }
        )

    return blocks.groupBy("block").cogroup(_borders(blocks, fitted, over).groupBy("block")).applyInArrow(decode, _OUT)
