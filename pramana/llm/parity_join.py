"""N-gram Jaccard join by parity sketches.

The set of a text holds the XXH64 hashes of its distinct shingles. Two sets link
when their Jaccard similarity is at least SIMILARITY (as a fraction of whole
numbers). A sketch has a segment for each part of the hash range, and in it a bit
that is flipped by each shingle: every shingle in one set but not in the other
changes one bit at most, so the Hamming distance of two sketches is a lower
bound of the sets' symmetric difference.

Sizes are cut into bands such that a set links within its band and the next one
only, and each band has a bound d on the symmetric difference of a link. A
band's sketch has more than d segments, so linked sets agree in a whole segment
(pigeonhole); sets meet on the hash of its bits. The segments above d + 1
allow to leave out segments with few bits set, which say little: a set does so
only while it has fewer of them than there are segments to spare. What two sets
share at least then holds one that both have sent.

Equal sets are one before the join, however many copies there are. Sets that meet
on a segment get a star, not all pairs; the stars' components are the groups in
which links can be. Each group goes to a task with its shingles once (groups of
more than UNIT shingles: by pairs of blocks, in tasks of their own) and is
searched breadth-first over sets not yet reached: first by the Hamming distance
of whole sketches, then by the exact size of the intersection. Links found so
connect every two sets that a chain of links connects.

A null or blank text has an empty set, which links with nothing, not even with
its like: its component is its own key. A text of fewer words than a shingle has
is one shingle. Rows with equal sets are in one component, whatever their keys; a
component of rows without a key has a null component_id, and so has an empty set
without one. Texts of any length are taken whole. An empty table gives an empty
result. Other columns, of any name, are not looked at. Shingles count as equal
when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, likely_in, materialise
from .components import components

SHINGLE = 3
#: A link: LINK[1] * intersection >= LINK[0] * union.
LINK = (90, 100)
#: Bits of a segment (a power of two), and the bits set under which a segment says little.
SEGMENT_BITS, FEW_BITS = 4096, 3
#: Shingles of a group that one task searches.
UNIT = 1 << 22
NONE = np.empty(0, np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text given as UTF-8, ascending."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= width:
        pieces = [joined]
    else:
        pieces = [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    return np.unique(np.fromiter(map(_hash, pieces), np.uint64, len(pieces)))


def bands(link: tuple[int, int] = LINK, most: int = 1 << 40) -> list[int]:
    """First size of each band: the largest partner of a band's last size is the last size of the next band."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * link[1] // link[0] + 1)
    return out


_bands = lru_cache(maxsize=8)(bands)


@lru_cache(maxsize=4096)
def scheme(band: int, link: tuple[int, int] = LINK) -> tuple[int, int]:
    """(greatest symmetric difference of a link with a set of the band, segments of the band's sketch)."""
    last = _bands(link)[band + 1] - 1
    union = last * link[1] // link[0]
    most = union * (link[1] - link[0]) // link[1]
    return most, most + 1 + (most + 3) // 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last step of splitmix64: spreads whole numbers over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The bits set in the sketch, ascending: SEGMENT_BITS for each segment, each bit flipped by its shingles."""
    spread = _mixed(hashes)
    segment = (spread >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    bits, flips = np.unique(segment * np.uint64(SEGMENT_BITS) | spread & np.uint64(SEGMENT_BITS - 1), return_counts=True)
    return bits[flips % 2 == 1]


def segment_keys(hashes: np.ndarray, band: int, link: tuple[int, int] = LINK) -> np.ndarray:
    """A hash of the band and the bits of each segment that is sent."""
    most, segments = scheme(band, link)
    bits = sketch(hashes, segments)
    segment = (bits // np.uint64(SEGMENT_BITS)).astype(np.int64)
    n_bits = np.bincount(segment, minlength=segments)
    value = np.zeros(segments, np.uint64)
    held = np.flatnonzero(n_bits)
    if len(held):
        starts = (np.cumsum(n_bits) - n_bits)[held]
        value[held] = np.bitwise_xor.reduceat(_mixed(bits & np.uint64(SEGMENT_BITS - 1) | np.uint64(1 << 40)), starts)
    keys = _mixed(value + _mixed(np.arange(segments, dtype=np.uint64) | np.uint64(band << 32)))
    few = n_bits < FEW_BITS
    return keys[~few] if few.sum() < segments - most else keys


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, link: tuple[int, int] = LINK) -> DataFrame:
    """key, tie (hash of the text), n (size of the set), digest of the set, own and guest: segment keys by its band and by the one before."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).cast("binary").alias("text"))
    schema = rows.select("key", "tie").withColumns({"n": F.lit(0).cast("long"), "digest": F.lit(b""), "own": F.array().cast("array<long>"), "guest": F.array().cast("array<long>")}).schema
    edges = _bands(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, own, guest = [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), width)
                band = bisect_right(edges, len(found)) - 1
                sizes.append(len(found))
                marks.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                own.append(segment_keys(found, band, link).view(np.int64) if len(found) else NONE)
                guest.append(segment_keys(found, band - 1, link).view(np.int64) if len(found) and band else NONE)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(own, longs), pa.array(guest, longs)], schema.names)

    return in_arrow(rows, run, schema)


def meetings(distinct: DataFrame) -> DataFrame:
    """Stars (a, b) of the sets (id, own, guest) that meet on a segment, one of them by its own band."""
    sent = distinct.select("id", F.explode("own").alias("segment"), F.lit(True).alias("own"))
    sent = sent.unionByName(distinct.select("id", F.explode("guest").alias("segment"), F.lit(False).alias("own")))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment_now, first_now = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            segment, who, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fresh = np.r_[segment[0] != segment_now, segment[1:] != segment[:-1]]
            starts = np.flatnonzero(fresh)
            first = np.where(own[starts], who[starts], -1)  # guests alone do not meet
            if not fresh[0]:
                starts, first = np.r_[0, starts], np.r_[first_now, first]
            centre = np.repeat(first, np.diff(np.r_[starts, len(segment)]))
            segment_now, first_now = segment[-1], centre[-1]
            a, b = centre[centre >= 0], who[centre >= 0]
            pair = np.unique(np.stack([a, b])[:, a != b], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    dealt = sent.select("segment", "id", "own").repartition("segment").sortWithinPartitions("segment", F.col("own").desc(), "id")
    return in_arrow(dealt, stars, "a long, b long").distinct()


def links(ids: list[int], sets: list[np.ndarray], link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """Links (a, b) that connect the sets of each component, breadth-first."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    ids, sets, sizes = [ids[i] for i in order], [sets[i] for i in order], sizes[order]
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(sizes)]
    words = max(1, int(sizes[-1]) // 16)  # four bits for each shingle of the largest
    held = np.zeros((len(sets), words), np.uint64)
    for i, x in enumerate(sets):
        bit = _mixed(x ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(words * 64)
        np.bitwise_xor.at(held[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    marked = np.zeros(int(shingle.max()) + 1, bool)
    low, high = link
    left, found = np.arange(len(sets)), []

    def near(f: int, left: np.ndarray) -> np.ndarray:
        most_union = np.minimum(sizes[f], sizes[left]) * high // low
        fits = np.maximum(sizes[f], sizes[left]) <= most_union
        at = np.flatnonzero(fits)
        both = sizes[f] + sizes[left[at]]
        differ = np.zeros(len(at), np.int64)
        for a in range(0, len(at), 4096):
            differ[a : a + 4096] = np.bitwise_count(held[left[at[a : a + 4096]]] ^ held[f]).sum(axis=1)
        at = at[differ * (high + low) <= both * (high - low)]  # what a link with these sizes allows
        out = np.zeros(len(left), bool)
        mine = shingle[ends[f] : ends[f + 1]]
        marked[mine] = True
        for i in at:
            g = left[i]
            shared = int(np.count_nonzero(marked[shingle[ends[g] : ends[g + 1]]]))
            out[i] = high * shared >= low * (sizes[f] + sizes[g] - shared)
        marked[mine] = False
        return out

    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            f = front.pop()
            hit = near(f, left)
            found += [(ids[f], ids[g]) for g in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return found


def _linked(docs: DataFrame, distinct: DataFrame, key: str, text: str, width: int, link: tuple[int, int], unit: int) -> DataFrame:
    """Links (a, b) of distinct sets (id, rep, n, ...) that connect each component."""
    groups = materialise(components(meetings(distinct)), "groups")
    found = distinct.join(groups, distinct["id"] == groups["node"]).select("id", "rep", "n", "root")
    large = found.groupBy("root").agg(F.sum("n").alias("size"))
    found = found.join(large, "root")
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("size") / unit)).cast("int")
    found = found.withColumn("blocks", F.when(F.col("size") <= unit, 1).otherwise(blocks))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    unit_of = lambda j: F.xxhash64("root", F.least(j, mine), F.greatest(j, mine))
    found = found.withColumn("units", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), unit_of))
    chosen = materialise(found.select("id", "units", F.col("rep.key").alias("of"), F.col("rep.tie").alias("of_tie")), "chosen", groups)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).cast("binary").alias("text"))
    rows = likely_in(rows, chosen.select(F.col("of").alias("key"), F.col("of_tie").alias("tie")), ["key", "tie"])
    rows = rows.join(chosen, rows["key"].eqNullSafe(chosen["of"]) & (rows["tie"] == chosen["of_tie"])).select("id", "units", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x.as_py(), width).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "units", "shingles"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []

        def flush() -> pa.RecordBatch:
            pair = np.array(links(ids, held, link) if len(ids) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            for u, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if u != now:
                    yield flush()
                    now, ids, held = u, [], []
                if not ids or ids[-1] != i:  # rows equal in key and text
                    ids.append(i)
                    held.append(np.frombuffer(s.as_py(), np.uint64))
        yield flush()

    spread = in_arrow(rows, sets, "id long, units array<long>, shingles binary").select(F.explode("units").alias("unit"), "id", "shingles")
    return in_arrow(spread.repartition("unit").sortWithinPartitions("unit", "id"), search, "a long, b long")


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, link: tuple[int, int] = LINK, unit: int = UNIT) -> DataFrame:
    """key, n_shingles and component_id (least key reachable by links) of each row."""
    marked = materialise(sketches(docs, key, text, width, link), "sketches")
    same = marked.where("n > 0").groupBy("digest").agg(F.min(F.struct("key", "tie")).alias("rep"), F.min("key").alias("least"), *(F.first(c).alias(c) for c in ("n", "own", "guest")))
    distinct = materialise(same.withColumn("id", F.monotonically_increasing_id()), "distinct")
    groups = components(_linked(docs, distinct, key, text, width, link, unit))
    rooted = distinct.join(groups, distinct["id"] == groups["node"], "left").select("digest", "least", F.coalesce("root", "id").alias("root"))
    rooted = materialise(rooted, "rooted", distinct)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").select("digest", "component_id")
    found = marked.where("n > 0").join(known, "digest").select("key", "n", "component_id")
    alone = marked.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return found.unionByName(alone).toDF(key, "n_shingles", "component_id")
