"""Deep-shallow sorting of windows of a byte text.

Multikey quicksort orders windows to a shallow depth: a segment is parted in three by a pivot of eight bytes
(less, equal, greater), the equal part goes on eight bytes deeper, and all segments of a level are
parted at once; small segments are finished by sorting. Groups that still agree are long common prefixes and
are told apart by blind tries, which look at branching bytes only and compare one leaf in full.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, and windows up to which a segment is sorted without pivots.
SHALLOW, FEW = 128, 512


def eights(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text) + 1, ">u8", padded.tobytes(), strides=(1,))


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the segments, and whose they are."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + (begin - (np.cumsum(size) - size))[owner], owner


def shallow_sort(text: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``starts`` by their first ``depth`` bytes (a multiple of eight), and where in it each group of equals begins."""
    n, wide = len(starts), eights(text)
    order, opens = np.arange(n), np.zeros(n + 1, bool)
    key_at = lambda spots, deep: wide[starts[order[spots]] + deep].astype(np.uint64)
    begin, size, deep = np.array([0]), np.array([n]), np.array([0])
    later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        opens[begin[size > 0]] = True
        live = (size > 1) & (deep < depth)
        many = live & (size > FEW)
        later.append(tuple(x[live & ~many] for x in (begin, size, deep)))
        begin, size, deep = begin[many], size[many], deep[many]
        if not len(begin):
            break
        spots, owner = _spread(begin, size)
        key = key_at(spots, deep[owner])
        head = np.cumsum(size) - size
        x, y, z = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[owner]
        less, same = key < pivot, key == pivot
        parts, to, at = [], np.empty(len(spots), np.int64), begin
        for part, step in ((less, 0), (same, 8), (~(less | same), 0)):
            count = np.add.reduceat(part.astype(np.int64), head)
            to[part] = _spread(at, count)[0]
            parts.append((at, count, deep + step))
            at = at + count
        order[to] = order[spots]
        begin, size, deep = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin, size, deep = (np.concatenate(x) for x in zip(*later, strict=True))
    while len(begin):
        spots, owner = _spread(begin, size)
        key = key_at(spots, deep[owner])
        by = np.lexsort((key, owner))
        order[spots], key = order[spots][by], key[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        opens[spots[first]] = True
        size, begin, deep = np.diff(np.append(first, len(spots))), spots[first], deep[owner[first]] + 8
        live = (size > 1) & (deep < depth)
        begin, size, deep = begin[live], size[live], deep[live]
    return order, np.flatnonzero(opens[:n])


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two different strings of one length."""
    lo, hi = 0, len(a)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(text: bytes, starts: list[int], depth: int) -> list[list[int]]:
    """Classes of equal windows of ``depth`` bytes, in the windows' order; a window is given by its index in ``starts``.

    A leaf is the list of windows with one content; an inner node is (byte position, children by byte).
    """
    root: list | tuple = [0]
    for k in range(1, len(starts)):
        node, window = root, text[starts[k] : starts[k] + depth]
        while type(node) is tuple:
            node = node[1].get(window[node[0]]) or next(iter(node[1].values()))
        at = starts[node[0]]
        other = text[at : at + depth]
        if other == window:
            node.append(k)
            continue
        lcp, node, parent = _common(window, other), root, None
        while type(node) is tuple and node[0] < lcp:
            parent, node = node, node[1][window[node[0]]]
        if type(node) is tuple and node[0] == lcp:
            node[1][window[lcp]] = [k]
            continue
        inner = (lcp, {other[lcp]: node, window[lcp]: [k]})
        if parent is None:
            root = inner
        else:
            parent[1][window[parent[0]]] = inner
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> list[list[int]]:
    """Classes of two or more equal windows; each window is given by its index in ``starts``.

    The classes come in the order of a suffix array of ``starts`` cut at ``depth`` bytes.
    """
    if not len(starts):
        return []
    order, first = shallow_sort(text, starts, min(shallow, depth) // 8 * 8)
    ends = np.append(first[1:], len(order))
    several = ends - first > 1
    data, out = text.tobytes(), []
    index, places = order.tolist(), starts[order].tolist()
    for a, b in zip(first[several].tolist(), ends[several].tolist(), strict=True):
        if b - a == 2:  # a trie of two leaves
            if data[places[a] : places[a] + depth] == data[places[a + 1] : places[a + 1] + depth]:
                out.append(index[a:b])
            continue
        out.extend([index[a + k] for k in leaf] for leaf in blind_trie(data, places[a:b], depth) if len(leaf) > 1)
    return out
