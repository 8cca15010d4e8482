"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash
to blocks of bounded size, and each block is evolved on several islands, each
with a population of packings. A crossover injects whole well-filled bins of one
parent into the other, drops the bins that hold their pieces twice, and puts the
displaced pieces back: first in exchange for smaller ones where that fills a bin
better, then by best fit, largest first. After each epoch the best packing of an
island moves to the next. Pieces in loosely filled bins of all blocks are then
packed again together, until they fit in one block (or no more can be gained,
after MOST_ROUNDS at the latest).

Ids are those of a plain call of the tokenizers library: the added token in a text is one id.
Full pieces are sequences of their own. Repeated rows are packed each, and rows
without an id like any. Null and empty texts are pieces with the end id alone.
Texts of any length are encoded whole. Among equal lengths, any may come first. No
piece is dropped. An empty table has no sequences. Other columns are not kept.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise

CAPACITY = 2048
# Fixed value: the added token of the vocabulary.
ADDED = {"<|endoftext|>": 50256}
#: Pieces of a block, islands of a block, packings of an island, epochs, and generations of an epoch: all of them always run.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2000, 3, 6, 2, 30
LOOSE, MOST_ROUNDS = 0.985, 60
#: A run of as much white space is cut by hand.
LONG_BLANKS = 10_000


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


_BLANKS = regex.compile(rf"\p{{White_Space}}{{{LONG_BLANKS},}}")
_ONE_MATCH = r"[\s\S]+"


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text; the text between added tokens is encoded by itself.

    The library's pattern looks ahead behind each run of white space, which fails on
    very long ones. The pattern makes all but the last blank of a run one match (all
    of them at the end of the text or before an added token); long runs are cut so by hand.
    """
    encoding, ids, at = _encoding(path, pattern), [], 0
    for run in _BLANKS.finditer(text):
        last = run.end() == len(text) or any(text.startswith(token, run.end()) for token in ADDED)
        ids += encoding.encode(text[at : run.start()], allowed_special="all")
        at = run.end() - (not last)
        ids += _encoding(path, _ONE_MATCH).encode(text[run.start() : at], disallowed_special=())
    return ids + encoding.encode(text[at:], allowed_special="all")


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity if there are several."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece of every document."""
    schema = docs.select(F.col(key)).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode_text(value.as_py() or "", path, pattern), end_id], "<u4")
                for p, (s, n) in enumerate(piece_bounds(len(ids), capacity)):
                    owner.append(i)
                    rows.append((p, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            made = [pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *made], schema.names)

    return in_arrow(docs.select(key, text), run, schema)


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Put the pieces in `order` into `bins`, each into the fullest bin that takes it, else a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, members in enumerate(bins):
        left = capacity - sum(lengths[i] for i in members)
        room[left].append(b)
        mask |= 1 << left
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= need
        room[left].append(b)
        mask |= 1 << left
    return bins


class Packing:
    """A packing as arrays: the bin of each piece, and how full each bin is."""

    def __init__(self, of: np.ndarray, size: np.ndarray):
        self.of = np.unique(of, return_inverse=True)[1]
        self.fill = np.bincount(self.of, weights=size).astype(np.int64)

    @classmethod
    def from_bins(cls, bins: list[list[int]], size: np.ndarray) -> Packing:
        of = np.zeros(len(size), np.int64)
        for b, members in enumerate(bins):
            of[members] = b
        return cls(of, size)

    def bins(self) -> list[list[int]]:
        order = np.argsort(self.of, kind="stable")
        return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1)]

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then uneven filling."""
        return -len(self.fill), float(((self.fill / capacity) ** 2).sum())


def refill(of: np.ndarray, size: np.ndarray, free: np.ndarray, capacity: int) -> np.ndarray:
    """Place the `free` pieces (their bin is -1) again.

    A piece first takes the place of a smaller one where that fills a bin better
    (most of all, to the brim); the smaller one becomes free. What is left then
    goes by best fit, largest first, into the open bins or new ones.
    """
    left = sorted(free.tolist(), key=lambda i: -size[i])
    if (of >= 0).any():
        slack = capacity - np.bincount(of[of >= 0], weights=size[of >= 0]).astype(np.int64)
        placed = np.flatnonzero(of >= 0)
        placed = placed[slack[of[placed]] > 0]
        place, room = size[placed], size[placed] + slack[of[placed]]
        for n, i in enumerate(left):
            gain = np.where((place < size[i]) & (room >= size[i]), np.where(room == size[i], capacity, 0) + size[i] - place, 0)
            best = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[best] > 0:
                j = placed[best]
                b = of[j]
                of[i], of[j], left[n] = b, -1, int(j)
                slack[b] -= size[i] - size[j]
                placed[best], place[best] = i, size[i]
                mates = of[placed] == b
                room[mates] = place[mates] + slack[b]
    used = int(of.max()) + 1 if (of >= 0).any() else 0
    fills = np.bincount(of[of >= 0], weights=size[of >= 0], minlength=used).astype(np.int64).tolist()
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        rooms[capacity - fill].append(b)
        mask |= 1 << capacity - fill
    for i in sorted(left, key=lambda i: -size[i]):
        need = int(size[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        of[i] = b
        rooms[room - need].append(b)
        mask |= 1 << room - need
    return of


def crossover(one: Packing, two: Packing, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A few neighbouring well-filled bins of `two` injected whole into `one`; what they displace is placed again."""
    order = np.argsort(-two.fill, kind="stable")
    order = order[: max(1, len(order) // 2)]
    start, n = int(rng.integers(len(order))), int(rng.integers(1, max(2, len(order) // 6 + 1)))
    chosen = np.zeros(len(two.fill), bool)
    chosen[np.take(order, range(start, start + n), mode="wrap")] = True
    came = chosen[two.of]
    broken = np.zeros(len(one.fill), bool)
    broken[one.of[came]] = True  # these hold a piece twice now
    free = broken[one.of] & ~came
    of = np.where(came, two.of + len(one.fill), np.where(free, -1, one.of))
    return _settled(of, size, np.flatnonzero(free), capacity)


def mutate(packing: Packing, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The loosest bin and a few others emptied, and their pieces placed again."""
    gone = np.zeros(len(packing.fill), bool)
    gone[packing.fill.argmin()] = True
    gone[rng.integers(len(packing.fill), size=int(rng.integers(1, 5)))] = True
    free = gone[packing.of]
    return _settled(np.where(free, -1, packing.of), size, np.flatnonzero(free), capacity)


def _settled(of: np.ndarray, size: np.ndarray, free: np.ndarray, capacity: int) -> Packing:
    kept = of >= 0
    of[kept] = np.unique(of[kept], return_inverse=True)[1]
    return Packing(refill(of, size, free, capacity), size)


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """A population after `generations`, best first; an empty one is set up first, from best fit in several orders.

    Every generation runs, whether or not the bound on the bins is met already: a
    better filling leaves the loose bins emptier for the next round.
    """
    rng, size = np.random.default_rng(seed), np.array(lengths, np.int64)
    found = [Packing.from_bins(p, size) for p in population]
    while len(found) < POPULATION:
        noisy = size * (rng.uniform(0.8, 1.25, len(size)) if found else 1)
        found.append(Packing.from_bins(best_fit(lengths, np.argsort(-noisy, kind="stable").tolist(), capacity, []), size))
    rank = lambda p: p.fitness(capacity)
    found.sort(key=rank, reverse=True)
    for _ in range(generations):
        a, b = (min(rng.integers(len(found), size=2).tolist()) for _ in range(2))  # tournaments: the list is in order
        child = mutate(crossover(found[a], found[b], size, capacity, rng), size, capacity, rng)
        found.append(child)
        found.sort(key=rank, reverse=True)
        found.pop()
    return [p.bins() for p in found]


def _coded(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for b, members in enumerate(bins):
        out[members] = b
    return out.tobytes()


def _bins(coded: bytes) -> list[list[int]]:
    of = np.frombuffer(coded, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _pack_blocks(items: DataFrame, n_blocks: int, capacity: int, round_: int) -> DataFrame:
    """item, length, block, bin: one packing of each block of `items` (item, length)."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(n_blocks)).cast("long"))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("length"), F.col("item")))).alias("x"))
    blocks = blocks.select("block", F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("population", F.array().cast("array<binary>"))
    schema = "block long, items array<long>, lengths array<long>, island int, population array<binary>"

    spent: list[DataFrame] = []
    for epoch in range(EPOCHS):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for block, lengths, island, old in zip(frame["block"], frame["lengths"], frame["island"], frame["population"], strict=True):
                    known = [int(x) for x in lengths]
                    found = evolve(known, [_bins(x) for x in old], capacity, zlib.crc32(f"{round_} {block} {island} {epoch}".encode()))
                    made.append([_coded(x, len(known)) for x in found])
                yield frame.assign(population=made)

        state = state.select("block", "items", "lengths", "island", "population").mapInPandas(run, schema)
        state = materialise(state, "islands", *spent)
        spent = [state]
        if epoch < EPOCHS - 1:  # the elite of each island moves to the next
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("population", 1, 1).alias("guest"))
            state = state.join(elite, ["block", "island"]).withColumn("population", F.concat("guest", F.slice("population", 1, POPULATION - 1)))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [np.frombuffer(x[0], np.int32) for x in frame["population"]]
            yield pd.DataFrame({"block": frame["block"], "island": frame["island"], "items": frame["items"], "lengths": frame["lengths"], "bins": made, "used": [int(m.max()) + 1 for m in made]})

    coded = state.mapInPandas(number, "block long, island int, items array<long>, lengths array<long>, bins array<int>, used int")
    best = coded.groupBy("block").agg(F.min_by(F.struct("items", "lengths", "bins"), F.struct("used", "island")).alias("b"))
    return best.select("block", F.inline(F.arrays_zip(F.col("b.items"), F.col("b.lengths"), F.col("b.bins")))).toDF("block", "item", "length", "bin")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (with a column length of at most `capacity`) with sequence_id and offset."""
    items = materialise(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = items.where(F.col("length") >= capacity).select("item", "length", (-F.col("item") - 1).alias("sequence_id"))
    open_ = items.where(F.col("length") < capacity).select("item", "length")
    done, round_ = [whole], 0
    left, before = open_.count(), None
    while left:
        n_blocks = -(-left // BLOCK)
        packed = materialise(_pack_blocks(open_, n_blocks, capacity, round_), "packed")
        packed = packed.withColumn("sequence_id", (F.col("block") * 64 + round_) * (1 << 12) + F.col("bin"))  # a block has under 4096 bins
        fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        packed = packed.join(fill, "sequence_id")
        if n_blocks == 1 or left == before or round_ == MOST_ROUNDS:
            done.append(packed.select("item", "length", "sequence_id"))
            break
        tight = F.col("fill") >= capacity * LOOSE
        done.append(packed.where(tight).select("item", "length", "sequence_id"))
        open_ = materialise(packed.where(~tight).select("item", "length"), "loose")
        before, left, round_ = left, open_.count(), round_ + 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    within = Window.partitionBy("sequence_id").orderBy("item")  # at most `capacity` pieces
    placed = placed.withColumn("offset", F.sum("length").over(within) - F.col("length")).drop("length")
    return items.join(placed, "item").drop("item")
