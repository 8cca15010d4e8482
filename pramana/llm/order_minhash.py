"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so repeated ones differ. A hash
of k-mer and number falls into one of SLOTS slots (by its first bits: one
permutation for all slots); each slot keeps the two least, in the order in which
they stand in the text, and hashes that pair of k-mers. Two texts agree in a
slot only if they share its k-mers in the same order, so moving parts around
lowers the likeness where a plain MinHash would not notice.

A text shorter than a k-mer is one k-mer. A null or empty text has only empty
slots. Equal texts have equal fingerprints, so their likeness is 1. Repeated rows
and rows that share an id follow each other in the order of their texts' hashes;
rows without an id come first. Texts are taken whole, whatever their length. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .ordered import boundaries, dealt, first_keys, with_range

K, SLOTS, KEPT = 8, 64, 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PLACE = 24  # bits of a packed position
_SLOT_SHIFT = np.uint64(58)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers of code points, in text order."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(x) < K:
        total = np.uint64(len(x))
        for c in x:
            total = np.uint64((int(total) * int(_A) + int(c)) & 0xFFFFFFFFFFFFFFFF)
        return _mix(np.array([total])) if len(x) else x
    step = 1
    for factor in (_A, _B, _C):  # 2, 4, then 8 code points
        x = x[:-step] * factor + x[step:]
        step *= 2
    return _mix(x * _A)


def sketch(text: str | None) -> np.ndarray:
    """SLOTS values of 16 bits; 0 is an empty slot."""
    out = np.zeros(SLOTS, np.uint16)
    kmers = _kmers(text or "")
    n = len(kmers)
    if not n:
        return out
    if n < 1 << _PLACE:
        packed = np.sort((kmers >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64))
        place, name = (packed & np.uint64((1 << _PLACE) - 1)).astype(np.int64), packed >> np.uint64(_PLACE)
    else:
        name = kmers >> np.uint64(_PLACE)
        place = np.argsort(name, kind="stable")
        name = name[place]
    index = np.arange(n)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(name[1:], name[:-1], out=fresh[1:])
    number = index - np.maximum.accumulate(np.where(fresh, index, 0))
    value = _mix(name * _A + number.astype(np.uint64) * _C)
    chosen = index
    if n > 40 * SLOTS:  # the least of each slot are among the least overall, unless a slot comes out short
        limit = np.uint64(int((1 << 58) * 14 * SLOTS / n))
        few = np.flatnonzero((value & np.uint64((1 << 58) - 1)) < limit)
        if np.bincount((value[few] >> _SLOT_SHIFT).astype(np.int64), minlength=SLOTS).min() >= KEPT:
            chosen = few
    chosen = chosen[np.argsort(value[chosen], kind="stable")]
    slot = (value[chosen] >> _SLOT_SHIFT).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sizes = np.diff(np.r_[starts, len(slot)])
    one = chosen[starts]
    two = chosen[starts + np.minimum(sizes, KEPT) - 1]
    early, late = np.where(place[one] <= place[two], one, two), np.where(place[one] <= place[two], two, one)
    pair = _mix(name[early] * _A + _mix(name[late] + _C)) >> np.uint64(48)
    out[slot[starts]] = np.maximum(pair, 1)
    return out


def as_text(values: np.ndarray) -> str:
    """A fingerprint as hex digits."""
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the used slots in which two fingerprints agree."""
    used = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum() / used) if used else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each row."""
    schema = docs.select(key).withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(sketch(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], schema.names)

    return in_arrow(docs.select(key, text), run, schema)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the following one."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and likeness to that and to the next document.

    Next is by ascending key; rows that share a key follow one another by a hash
    of their text; after the last row comes the first. Ranges of keys are dealt
    to partitions, and each range also gets the first row of the range after it.
    """
    cuts = boundaries(docs, key, text)
    firsts = first_keys(docs, key, cuts)
    parts = sorted(firsts)
    ahead = {firsts[p]: (p, parts[i - 1]) for i, p in enumerate(parts)}  # i = 0: the last range wraps around
    ranged = with_range(docs, key, text, cuts)
    kind = ranged.withColumn("extra", F.lit(False)).schema

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, bool))], kind.names)
            keys = batch.column(0).to_pylist()
            at = [i for i, k in enumerate(keys) if k in ahead]
            if at:
                some = batch.take(pa.array(at))
                to = pa.array([ahead[keys[i]][1] for i in at], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), to, some.column(3), pa.array(np.ones(len(at), bool))], kind.names)

    out = docs.select(F.col(key).cast("long").alias(key)).withColumns({"n_chars": F.lit(0).cast("long"), "edited_sha256": F.lit(""), "fingerprint": F.lit(""), "edited_fingerprint": F.lit(""), "near_edited": F.lit(0.0), "near_next": F.lit(0.0)}).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, None  # the row before (part, key, text, sketch), and the range that is finished

        def row(now: tuple, following: str, mark: np.ndarray) -> tuple:
            new = edited(now[2], following)
            other = sketch(new)
            return (now[1], len(now[2]), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), as_text(now[3]), as_text(other), likeness(now[3], other), likeness(now[3], mark))

        for batch in batches:
            rows = []
            for key, value, part, _, extra in zip(*batch.columns, strict=True):
                here = part.as_py()
                if extra.as_py() and done == here:
                    continue
                value = value.as_py() or ""
                mark = sketch(value)
                if last is not None and last[0] == here:
                    rows.append(row(last, value, mark))
                last, done = ((here, key.as_py(), value, mark), done) if not extra.as_py() else (None, here)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], out.names)

    lent = in_arrow(ranged, lend, kind)
    return in_arrow(dealt(lent, len(cuts) + 1, "extra", "key", "tie"), walk, out)
