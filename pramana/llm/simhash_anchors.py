"""Near-duplicates by SimHash, joined with anchor points.

Fingerprints of 64 bits are linked when they differ in at most 4. The bits fall
in three segments of 22, 21 and 21; of two linked fingerprints, one segment
differs in at most one bit. The anchors of a segment are the words of a covering
code: a perfect Hamming code on its first 15 bits (covering radius 1) times all
values of the rest. A fingerprint lives at the anchor its segment decodes to,
and is copied to every anchor within covering radius plus one: the home of
anything one bit away is among them. Pairs are compared per anchor, and each
anchor gives a star for each group that it finds, never its pairs.

Equal fingerprints are collapsed before the join. The number of anchors follows
the number of fingerprints (SEGMENTS, PAIRED), and an anchor that is crowded none
the less is parted by a second covering code over other bits. An anchor is
searched breadth-first over fingerprints not yet reached, so dense groups cost
little. Stars are merged into components.

Null and blank texts have fingerprint zero and are linked like any other. Rows
that share an id count as one document for the component; a component of rows
without an id alone has a null component_id. Texts of any length are taken whole.
Equal rows are in one component. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise, unused
from .components import components

BITS = 4
SHINGLE = 4
#: Segments as ranges of bits (start, width): of two linked fingerprints, one segment differs in at most one bit.
SEGMENTS = (((0, 22),), ((22, 21),), ((43, 21),))
#: For more fingerprints than FEW: of five parts at least two differ in one bit at most when taken together, so each pair of parts is a segment, and anchors are 32 times as many.
_FIVE = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRED = tuple((_FIVE[i], _FIVE[j]) for i in range(5) for j in range(i))
FEW = 1 << 24
HAMMING = 15
#: Copies at an anchor beyond which they are dealt again, to anchors of the other bits; crowded anchors up to SENT are sent to all tasks, more are joined.
CROWD, SENT = 1 << 13, 100_000
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The SimHash of a text given as UTF-8."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= width:
        pieces = [joined]
    else:
        pieces = [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    hashes = np.fromiter(map(_hash, pieces), np.uint64, len(pieces)).view(np.uint8).reshape(-1, 8)
    if len(pieces) < 300:
        counts = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0)
    else:
        counts = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(pieces), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", tie: str = "tie") -> DataFrame:
    """key, a hash `tie` of the text, and its fingerprint `fp` as a signed long."""
    rows = docs.select(F.col(key), F.xxhash64(text).alias(tie), F.col(text).cast("binary").alias("fp"))
    schema = rows.withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], schema.names)

    return in_arrow(rows, run, schema)


def _syndromes() -> np.ndarray:
    values, out = np.arange(1 << HAMMING), np.zeros(1 << HAMMING, np.int64)
    for bit in range(HAMMING):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def _pairs() -> np.ndarray:
    """For each syndrome, the two-bit masks that lead to code words at distance 2."""
    out = np.zeros((HAMMING + 1, (HAMMING - 1) // 2), np.int64)
    for s in range(1, HAMMING + 1):
        out[s] = [1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, HAMMING + 1) if p ^ s and p < p ^ s]
    return out


_SYNDROME, _PAIR = _syndromes(), _pairs()


def _part(fp: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, int]:
    """The bits of the ranges side by side, and how many they are."""
    out, width = np.zeros(len(fp), np.int64), 0
    for low, n in ranges:
        out |= ((fp >> np.uint64(low)).astype(np.int64) & ((1 << n) - 1)) << width
        width += n
    return out, width


def anchors(fp: np.ndarray, segments: tuple = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: anchor, index of the fingerprint, whether it is the home."""
    found = []
    index = np.arange(len(fp))
    for number, ranges in enumerate(segments):
        part, width = _part(fp, ranges)
        block, rest = part & ((1 << HAMMING) - 1), part >> HAMMING
        s = _SYNDROME[block]
        home = block ^ np.where(s, 1 << np.maximum(s - 1, 0), 0)
        base = number << 32

        def add(code: np.ndarray, free: np.ndarray, who: np.ndarray, own: bool, base: int = base) -> None:
            found.append((base | free << HAMMING | code, who, np.full(len(who), own)))

        add(home, rest, index, True)
        for bit in range(width - HAMMING):
            add(home, rest ^ (1 << bit), index, False)
        off = np.flatnonzero(s)
        for j in range(_PAIR.shape[1]):
            add(block[off] ^ _PAIR[s[off], j], rest[off], off, False)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SPREAD = np.argsort(np.arange(64) % 3, kind="stable")


def spread(fp: np.ndarray) -> np.ndarray:
    """Fingerprints with every third bit side by side: a segment of these takes two thirds of its bits from outside each segment of those."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, _SPREAD]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64).ravel()


def _stars(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Groups of linked fingerprints as (member, least member) pairs; breadth-first."""
    left, members, roots = np.unique(fps), [], []
    while len(left) > 1:
        group, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near |= np.bitwise_count(left ^ f) <= bits
            front, left = left[near], left[~near]
            group.append(front)
        if len(group) > 1 and len(got := np.concatenate(group)) > 1:
            members.append(got[1:])
            roots.append(np.full(len(got) - 1, got[0]))
    return members, roots


def _links(anchor: np.ndarray, fp: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of whole anchors; rows are sorted by anchor, homes first."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    homes = np.add.reduceat(own.astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    first = np.repeat(fp[starts], sizes)
    single = (homes == 1)[group]  # one home: compare all with it at once
    near = single & (np.bitwise_count(fp ^ first) <= bits) & (fp != first)
    members, roots = [fp[near]], [first[near]]
    for g in np.flatnonzero((homes > 1)):
        a, b = starts[g], starts[g] + sizes[g]
        m, r = _stars(fp[a:b], bits)
        members += m
        roots += r
    return np.concatenate(members), np.concatenate(roots)


def links(distinct: DataFrame, bits: int = BITS, segments: tuple = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect every two of the distinct fingerprints `fp` within `bits` bits.

    Copies at an anchor that holds more than `crowd` of them are dealt once more,
    to anchors of the spread bits: fingerprints that share one segment part there.
    """

    def batches_of(anchor: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(anchor), 1 << 18):
            cut = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[cut]), pa.array(fp[cut].view(np.int64)), pa.array(own[cut])], ["anchor", "fp", "own"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            anchor, who, own = anchors(fp, segments)
            yield from batches_of(anchor, fp[who], own)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            anchor, who, own = anchors(spread(fp))
            name = (first[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (anchor.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            yield from batches_of((name | np.uint64(1 << 63)).view(np.int64), fp[who], own)  # first anchors are never negative

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b = _links(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
            made = np.unique(np.stack([a, b]), axis=1).view(np.int64) if len(a) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, fp, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if cut or (kept and kept[-1][0][-1] != anchor[0]):
                yield flush([*kept, (anchor[:cut], fp[:cut], own[:cut])]) if cut else flush(kept)
                kept = []
            kept.append((anchor[cut:], fp[cut:], own[cut:]))
        if kept:
            yield flush(kept)

    schema = "anchor long, fp long, own boolean"
    copies = in_arrow(distinct.select("fp"), replicate, schema)
    crowded = materialise(copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("anchor"), "crowded")
    n = crowded.count()
    if n:
        marked = F.broadcast(crowded) if n <= SENT else crowded
        copies = copies.join(marked, "anchor", "left_anti").unionByName(in_arrow(copies.join(marked, "anchor"), again, schema))
    return in_arrow(copies.repartition("anchor").sortWithinPartitions("anchor", F.col("own").desc()), compare, "a long, b long")


def _grouped(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """key, tie, fp, root (names the component) and component_id (its least key) of each row."""
    marked = materialise(fingerprints(docs.select(key, text), key, text), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    segments = SEGMENTS if distinct.count() <= FEW else PAIRED
    groups = components(links(distinct.select("fp"), bits, segments))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (least key reachable) for each row."""
    return _grouped(docs, key, text, bits).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component: one with its least key; of several such texts, that of the least hash.

    Different texts under one key stay both, unless they are near-copies of each other
    or of a row with a smaller key. Rows without a key can't be named as copies, and stay.
    """
    tie = unused(docs, "tie")[0]
    firsts = _grouped(docs, key, text, bits).where(F.col(key) == F.col("component_id"))
    firsts = firsts.groupBy("root").agg(F.min(F.struct(key, "tie")).alias("x")).select(F.col(f"x.{key}").alias(key), F.col("x.tie").alias(tie))
    single = docs.withColumn(tie, F.xxhash64(text)).join(firsts, [key, tie], "left_semi").dropDuplicates([key, tie])
    return single.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
