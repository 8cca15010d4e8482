"""Periodic runs of words, found by enumerating maximal pairs.

A run is a stretch of words with smallest period q, at least two periods and
`shortest` words long, that no neighbouring word extends. It is a maximal pair:
the positions i and i + q, from which l = length - q words agree, while the words
before them differ and so do the words behind. Conversely a maximal pair at
distance q <= l with q + l >= shortest is a stretch of period q that nothing
extends, and the least q of all pairs with the same stretch is its smallest
period. So nothing is searched for but maximal pairs under these two bounds.

Both bounds together need l >= shortest / 2. Suffixes of all texts of a batch are
sorted by doubling in numpy; only suffixes whose first shortest / 2 words occur
twice in their text stay in play. Their tree of LCP intervals is walked from the
leaves up. Each interval holds its positions in lists by the word to the left;
when a child joins, each position of the smaller side looks into the lists of
other left words of the larger side, at distances up to l only.

A null, empty or blank text has no words and no run. Texts are taken whole, batches
are bounded by bytes; a text of one word a million times costs time in proportion to
n log n. Rows that share an id, or have none, give a row each. Equal texts give
equal results. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

SHORTEST = 12
#: Words sorted together, about: texts of a batch are gathered until they have as many.
TOGETHER = 1 << 16
Run = tuple[int, int, int]  # start, length, period


def _levels(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Positions whose first `least` words occur twice in their text, in order of their suffixes; ranks by prefix length; final ranks.

    `words` holds a sign of its own behind each text, so no prefix reaches into the next.
    """
    n = len(words)
    rank = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True)[1]

    def shifted(of: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - by)] = of[by:] + 1
        return out

    grown, length = {1: rank}, 1
    while length * 2 <= least:  # 1, 2, 4, ... words
        rank = np.unique(rank * (n + 1) + shifted(rank, length), return_inverse=True)[1]
        length *= 2
        grown[length] = rank
    while length < least:  # the rest, by the longest step that fits
        step = max(k for k in grown if length + k <= least)
        rank = np.unique(rank * (n + 1) + shifted(grown[step], length), return_inverse=True)[1]
        length += step
    # Ranks become the place of the first of the group, so that splitting a group leaves the others as they are.
    counts = np.bincount(rank, minlength=n)
    place = (np.cumsum(counts) - counts)[rank]
    active = np.flatnonzero(counts[rank] > 1)
    levels, all_active = [], active
    while len(active):
        levels.append((length, place.copy()))
        behind = np.minimum(active + length, n - 1)
        order = np.lexsort((place[behind], place[active]))
        active, first, second = active[order], place[active][order], place[behind][order]
        fresh = np.r_[True, first[1:] != first[:-1]]
        apart = fresh | np.r_[True, second[1:] != second[:-1]]
        starts, groups = np.flatnonzero(apart), np.flatnonzero(fresh)
        sub = np.repeat(starts, np.diff(np.r_[starts, len(active)]))
        group = np.repeat(groups, np.diff(np.r_[groups, len(active)]))
        place = place.copy()
        place[active] = first + (sub - group)
        sizes = np.diff(np.r_[starts, len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        length *= 2
    return all_active[np.argsort(place[all_active], kind="stable")], levels, place


def _common(x: np.ndarray, y: np.ndarray, levels: list[tuple[int, np.ndarray]], words: np.ndarray) -> np.ndarray:
    """Words that agree from x and from y on; 0 where fewer than the first level has.

    Past its level of `length` words, two suffixes agree in less than twice as many: steps of falling size, then word by word below the first.
    """
    n, out = len(words), np.zeros(len(x), np.int64)
    for length, place in reversed(levels):
        a, b = np.minimum(x + out, n - 1), np.minimum(y + out, n - 1)
        same = (place[a] == place[b]) & (a != b)
        out += np.where(same, length, 0)
    open_ = np.flatnonzero(out)
    while len(open_):
        a, b = x[open_] + out[open_], y[open_] + out[open_]
        open_ = open_[words[a] == words[b]]
        out[open_] += 1
    return out


class _Interval:
    """Positions of an LCP interval, all in order, and in order for each left word."""

    __slots__ = ("all", "by")

    def __init__(self, position: int, left: int):
        self.all, self.by = [position], {left: [position]}


def _join(one: _Interval, two: _Interval, common: int, shortest: int, found: dict[tuple[int, int], int]) -> _Interval:
    """Both children together; maximal pairs across them at distances of at most `common` go to `found`."""
    small, large = (one, two) if len(one.all) <= len(two.all) else (two, one)
    least = max(1, shortest - common)
    for left, positions in small.by.items():
        for p in positions:
            a, b = bisect_left(large.all, p - common), bisect_right(large.all, p + common)
            if a == b:
                continue
            lists = large.by
            if b - a <= len(lists):  # fewer positions near than left words: look at each position
                near = [q for q in large.all[a:b] if left not in lists or not _holds(lists[left], q)]
            else:
                near = [q for other, x in lists.items() if other != left for q in x[bisect_left(x, p - common) : bisect_right(x, p + common)]]
            for q in near:
                period = abs(p - q)
                if period >= least:
                    key = (min(p, q), common + period)
                    if found.get(key, period) >= period:
                        found[key] = period
    for left, positions in small.by.items():
        into = large.by.setdefault(left, [])
        for p in positions:
            insort(into, p)
            insort(large.all, p)
    return large


def _holds(ordered: list[int], x: int) -> bool:
    at = bisect_left(ordered, x)
    return at < len(ordered) and ordered[at] == x


def _pairs(positions: list[int], common: list[int], left: list[int], shortest: int, found: dict[tuple[int, int], int]) -> None:
    """Walks the LCP intervals of neighbouring suffixes from the leaves up. common[i]: words that suffixes i - 1 and i share."""
    stack: list[tuple[int, _Interval]] = []
    last = _Interval(positions[0], left[0])
    for i in range(1, len(positions)):
        while stack and stack[-1][0] > common[i]:
            depth, before = stack.pop()
            last = _join(before, last, depth, shortest, found)
        if stack and stack[-1][0] == common[i]:
            depth, before = stack.pop()
            last = _join(before, last, depth, shortest, found)
        stack.append((common[i], last))
        last = _Interval(positions[i], left[i])
    while stack:
        depth, before = stack.pop()
        last = _join(before, last, depth, shortest, found)


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[list[Run]]:
    """For each list of words, its runs in order of start, then period."""
    least = -(-shortest // 2)
    known: dict[bytes, int] = {}
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    bases = np.cumsum(sizes) - sizes
    words = np.full(int(sizes.sum()), -1, np.int64)
    for base, text in zip(bases.tolist(), texts, strict=True):
        words[base : base + len(text)] = [known.setdefault(w, len(known)) for w in text]
    words[words < 0] = len(known)  # the sign behind a text; the text's number tells them apart
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    order, levels, _ = _levels(words, doc, least)
    if not len(order):
        return out
    words = np.where(words == len(known), -1 - doc, words)
    common = np.r_[0, _common(order[:-1], order[1:], levels, words)]
    before = np.where(order == bases[doc[order]], -1 - doc[order], words[np.maximum(order - 1, 0)])
    cuts = np.flatnonzero(common < least).tolist() + [len(order)]
    found: dict[tuple[int, int], int] = {}
    positions, shared, left = order.tolist(), common.tolist(), before.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            _pairs(positions[a:b], shared[a:b], left[a:b], shortest, found)
    for (start, length), period in found.items():
        d = int(doc[start])
        out[d].append((start - int(bases[d]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those behind the first period of a run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """key, n_words, runs (array of start, length, period, ordered) and collapsed (the kept words, joined by a blank) for each row."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    runs_column = F.array().cast("array<struct<start:long,length:long,period:long>>")
    schema = docs.select(F.col(key)).withColumns({"n_words": F.lit(0).cast("long"), "runs": runs_column, "collapsed": F.lit("")}).schema

    def some(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, shortest)
        collapsed = [b" ".join(kept_words(w, r)).decode() for w, r in zip(texts, found, strict=True)]
        made = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(run_type))
        return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in texts], pa.int64()), made, pa.array(collapsed, pa.string())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begun, n = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                words = (value.as_py() or b"").split()  # bytes: the six ASCII blanks only
                texts.append(words)
                n += len(words)
                if n >= TOGETHER:
                    yield some(batch.column(0).slice(begun, len(texts)), texts)
                    texts, begun, n = [], i + 1, 0
            if texts:
                yield some(batch.column(0).slice(begun, len(texts)), texts)

    return in_arrow(docs.select(F.col(key), F.col(text).cast("binary").alias("text")), run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_runs, the longest run (ties: least start, then period) and digests of all runs and of the kept words."""
    order = F.array_sort("runs", lambda a, b: F.when(a.length != b.length, b.length - a.length).when(a.start != b.start, a.start - b.start).otherwise(a.period - b.period).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.get(order, 0))
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
