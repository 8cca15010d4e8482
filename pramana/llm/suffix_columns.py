"""Removal of repeated passages by column-wise suffix construction.

Every string of WIDTH bytes that starts at two places, in one document or two,
is found, and all bytes under such strings are removed.

Dealing out. The k-grams of a string have hashes; the least (leftmost of equal
ones) names the string's anchor. Equal strings have equal anchors, at the same
place within them. The starts that share an anchor form a run, and the text under
a run is a fragment. Fragments are dealt by anchor hash; of equal ones met before
the shuffle only one is dealt so, whatever a passage's share of the input. An anchor with one
fragment holds no repeat; equal fragments repeat throughout; only the different
fragments of an anchor, one copy of each, go on.

Sorting. In a task, the fragments of many anchors form a collection of
documents. The part from the anchor on is a document's end marker, in order of
its bytes. Each round inserts one symbol of every document, from the right: the
last-to-first mapping of the collection's Burrows-Wheeler transform gives the
places of the new suffixes, the transform takes up their preceding symbols, and
the common prefixes of the round's suffixes come from the minima of those of the
round before. Transform and common prefixes pass from round to round through
files, which are read and written from front to back. A suffix is repeated if
it shares WIDTH bytes with a neighbour.

Null texts are empty. Texts under WIDTH bytes keep all; longer ones of any length
are handled in pieces of CHUNK starts. Rows that share an id count as documents of
their own; equal rows repeat each other. Rows without an id are handled like any.
An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import in_arrow, materialise, unused

WIDTH, GRAM = 200, 64
WINDOW = WIDTH - GRAM + 1  # k-grams of a string
COMBINED = 1 << 18  # fragments combined at a time before the shuffle
COLLECTION = 4096  # fragments sorted together, about: an anchor's are never parted
CHUNK = 1 << 20  # starts handled at a time
_PLACE = np.uint64(24)
_END = 255  # never a byte of UTF-8
_ONE, _MANY, _SETTLED = 0, 1, 2  # a fragment alone in its window, one that stands for several, one that another stands for
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams that start at each byte."""
    x, step = data.astype(np.uint64), 1
    for factor in _FACTORS:  # 2, 4, ... 64 bytes
        x = x[:-step] * factor + x[step:]
        step *= 2
        if step in (8, 64):
            x ^= x >> np.uint64(32)
    x *= _FACTORS[0]
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from block-wise running minima."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, first start, anchor's place and last start of each run, in pieces."""
    for low in range(0, len(text) - WIDTH + 1, CHUNK):
        part = text[low : low + CHUNK + WIDTH - 1]
        grams = _grams(np.frombuffer(part, np.uint8))
        least = _sliding_min((grams >> _PLACE) << _PLACE | np.arange(len(grams), dtype=np.uint64), WINDOW)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        last = np.r_[first[1:], len(least)] - 1
        yield grams[place], low + first, low + place, low + last


class _File:
    """An array that lives in a file and passes through it from front to back."""

    def __init__(self, folder: str, name: str):
        self.path = Path(folder, name)

    def write(self, x: np.ndarray) -> None:
        x.tofile(self.path)

    def read(self, kind: type) -> np.ndarray:
        return np.fromfile(self.path, kind)


def repeated_starts(fragments: list[bytes], anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each fragment, which of its starts 0..last hold a string that another fragment holds too."""
    m, most = len(fragments), int(anchor.max())
    heads, tails = np.full((m, most + 1), _END, np.uint8), np.full((m, WIDTH), _END, np.uint8)
    for i, text in enumerate(fragments):
        data = np.frombuffer(text, np.uint8)
        at = anchor[i]
        heads[i, :at] = data[:at][::-1]
        tails[i, : len(data) - at] = data[at:]
    whole = [t.tobytes() for t in tails]
    docs = np.array(sorted(range(m), key=whole.__getitem__))
    differ = tails[docs[1:]] != tails[docs[:-1]]
    common = np.zeros(m + 1, np.int32)
    common[1:m] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    found = np.zeros((m, int(last.max()) + 1), bool)
    with tempfile.TemporaryDirectory() as folder:
        transform, prefixes = _File(folder, "transform"), _File(folder, "prefixes")
        transform.write(heads[docs, 0])
        prefixes.write(common)
        place = np.arange(m)  # of each document's newest suffix, in order
        for round_ in range(most + 1):
            common = prefixes.read(np.int32)
            start = anchor[docs] - round_
            own = (start >= 0) & (start <= last[docs])
            found[docs[own], start[own]] = (np.maximum(common[:-1], common[1:]) >= WIDTH)[own]
            symbols = transform.read(np.uint8)
            live = np.flatnonzero(symbols[place] != _END)
            if not len(live):
                break
            by_symbol = np.argsort(symbols, kind="stable")[: int((symbols != _END).sum())]
            fresh = np.zeros(len(symbols), bool)
            fresh[place[live]] = True
            fresh = fresh[by_symbol]  # last-to-first: which suffixes, after the end markers, are new
            came = by_symbol[fresh]
            index = live[np.searchsorted(place[live], came)]
            symbol = symbols[came]
            grown = np.zeros(len(index) + 1, np.int32)
            same = np.flatnonzero(symbol[1:] == symbol[:-1])
            if len(same):
                pairs = np.stack([index[same] + 1, index[same + 1] + 1], axis=1).ravel()
                grown[same + 1] = 1 + np.minimum.reduceat(common, pairs)[::2]
            docs = docs[index]
            place = m + np.flatnonzero(fresh)
            merged = np.empty(m + len(fresh), np.uint8)
            merged[:m] = symbols[:m]
            rest = merged[m:]
            rest[~fresh] = symbols[m:]
            rest[fresh] = heads[docs, round_ + 1]
            transform.write(merged)
            prefixes.write(grown)
    return found


def _spots(table: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _unpack(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, anchor and last start relative to it, of a packed place."""
    return spot >> 16, spot >> 8 & 255, spot & 255


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tie, low, high: byte ranges under repeated strings (they may overlap).

    tie (a hash of the text) tells apart rows that share a key.
    """
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    kind = rows.select("doc").schema

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments of all runs, combined before the shuffle: of equal ones in a window, one goes on for all."""
        names, sames, spots, owners, docs, ties = [], [], [], [], [], []
        count = 0

        def combined() -> pa.RecordBatch:
            name, same, spot = (np.concatenate(x) for x in (names, sames, spots))
            order = np.lexsort((same, name))
            name, same, spot = name[order], same[order], spot[order]
            again = np.r_[False, (name[1:] == name[:-1]) & (same[1:] == same[:-1])]
            state = np.where(again, _SETTLED, np.where(np.r_[again[1:], False], _MANY, _ONE)).astype(np.int8)
            spread = np.arange(len(name), dtype=np.uint64) * _FACTORS[0] ^ spot.astype(np.uint64) * _FACTORS[1]
            name = np.where(again, spread, name)  # settled rows need no meeting: any task will do
            made = [pa.array(name.view(np.int64)), pa.array(same.view(np.int64)), pa.concat_arrays(docs).take(pa.array(order)), pa.concat_arrays(ties).take(pa.array(order)), pa.array(spot), pa.array(state)]
            for x in (names, sames, spots, docs, ties):
                x.clear()
            return pa.RecordBatch.from_arrays(made, ["name", "same", "doc", "tie", "spot", "state"])

        for batch in batches:

            def keep(batch: pa.RecordBatch = batch) -> None:
                if owners:
                    rows = pa.array(np.concatenate(owners))
                    docs.append(batch.column(0).take(rows))
                    ties.append(batch.column(1).take(rows))
                    owners.clear()

            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                for name, first, place, last in runs(data):
                    names.append(name)
                    sames.append(np.fromiter(map(xxhash.xxh3_64_intdigest, [data[a : b + WIDTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.uint64, len(first)))
                    spots.append(first << 16 | (place - first) << 8 | (last - first))
                    owners.append(np.full(len(first), i))
                    count += len(first)
                    if count >= COMBINED:
                        keep()
                        yield combined()
                        count = 0
            keep()
        if count:
            yield combined()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (name, same): which are repeated throughout, and which stand for their equals in sorting.

        Settled rows are repeated, whatever else comes, and pass through.

        Keeps two rows between batches, however many share an anchor: the last
        one, judged when its successor is known, and the first of an anchor
        whose second kind of fragment has not been seen yet.
        """
        names = ["name", "doc", "tie", "spot", "whole", "sort"]
        before: tuple[int, int] | None = None  # of the row judged last
        row: pa.RecordBatch | None = None  # not judged yet
        waiting: pa.RecordBatch | None = None  # judged, but for sorting

        def out(rows: pa.RecordBatch, whole: np.ndarray, sort: np.ndarray) -> pa.RecordBatch:
            keep = pa.array(whole | sort)
            made = [*(rows.column(c) for c in ("name", "doc", "tie", "spot")), pa.array(whole), pa.array(sort)]
            return pa.RecordBatch.from_arrays(made, names).filter(keep)

        def judge(rows: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
            """The first n of `rows`; one more may follow them."""
            nonlocal before, waiting
            name, same = _spots(rows, "name"), _spots(rows, "same")
            old = np.r_[before is not None and before[0] == name[0], name[1:] == name[:-1]]
            equal = old & np.r_[before is not None and before[1] == same[0], same[1:] == same[:-1]]
            ends = np.flatnonzero(~equal)  # where another kind begins
            whole = equal[:n] | np.r_[equal[1:], False][:n] | (_spots(rows, "state")[:n] == _MANY)
            if waiting is not None and len(ends):
                if old[ends[0]]:
                    yield out(waiting, _spots(waiting, "whole"), np.array([True]))
                waiting = None
            sort = ~equal[:n] & old[:n]  # not the first kind of its anchor
            opening = np.flatnonzero(~old[:n])
            following = np.searchsorted(ends, opening, side="right")
            known = following < len(ends)
            sort[opening[known]] = old[ends[following[known]]]
            if len(opening) and not known[-1]:
                i = int(opening[-1])
                waiting = pa.RecordBatch.from_arrays([*rows.slice(i, 1).columns, pa.array(whole[i : i + 1])], [*rows.schema.names, "whole"])
            before = (name[n - 1], same[n - 1])
            yield out(rows.slice(0, n), whole, sort)

        for batch in batches:
            settled = _spots(batch, "state") == _SETTLED
            if settled.any():
                passed = batch.filter(pa.array(settled))
                yield out(passed, np.ones(passed.num_rows, bool), np.zeros(passed.num_rows, bool))
                batch = batch.filter(pa.array(~settled))
            if batch.num_rows:
                rows = batch if row is None else pa.Table.from_batches([row, batch]).combine_chunks().to_batches()[0]
                if rows.num_rows > 1:
                    yield from judge(rows, rows.num_rows - 1)
                row = rows.slice(rows.num_rows - 1)
        if row is not None:
            yield from judge(row, 1)

    doc_type = kind["doc"].dataType.simpleString()
    marked = in_arrow(rows, mark, f"name long, same long, doc {doc_type}, tie long, spot long, state tinyint")
    dealt = marked.repartition("name").sortWithinPartitions("name", "same")
    judged = materialise(in_arrow(dealt, meet, f"name long, doc {doc_type}, tie long, spot long, whole boolean, sort boolean"), "anchors")

    wanted = judged.where("sort").groupBy("doc", "tie").agg(F.collect_list(F.struct("name", "spot", "whole")).alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes, found = lists.value_lengths().to_numpy(), lists.flatten()
            first, _, last = _unpack(found.field("spot").to_numpy())
            at, parts = 0, []
            for value, n in zip(batch.column(2), sizes.tolist(), strict=True):
                data = value.as_py()
                parts += [data[a : a + b + WIDTH] for a, b in zip(first[at : at + n].tolist(), last[at : at + n].tolist(), strict=True)]
                at += n
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *(found.field(c) for c in ("name", "spot", "whole")), pa.array(parts, pa.binary())], ["doc", "tie", "name", "spot", "whole", "part"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            spot = _spots(table, "spot")
            first, anchor, last = _unpack(spot)
            found = repeated_starts(table.column("part").to_pylist(), anchor, last)
            found[_spots(table, "whole")] = False  # removed as a whole already
            edge = np.zeros((len(found), 1), np.int8)
            steps = np.diff(np.concatenate([edge, found, edge], axis=1).astype(np.int8), axis=1)
            (who, low), (_, high) = np.nonzero(steps == 1), np.nonzero(steps == -1)
            return pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(who)).combine_chunks() for c in ("doc", "tie")), pa.array(first[who] + low), pa.array(first[who] + high - 1 + WIDTH)], ["doc", "tie", "low", "high"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = _spots(batch, "name")
            cut_at = int(np.searchsorted(name, name[-1]))
            if count >= COLLECTION and (cut_at or _spots(held[-1], "name")[-1] != name[0]):
                edge = cut_at or 0
                yield flush([*held, batch.slice(0, edge)] if edge else held)
                held, count, batch = [], 0, batch.slice(edge)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield flush(held)

    wanted = wanted.toDF("w_doc", "w_tie", "x")
    texts = rows.join(wanted, F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("tie") == F.col("w_tie"))).select("doc", "tie", "data", "x")
    parts = in_arrow(texts, cut, f"doc {doc_type}, tie long, name long, spot long, whole boolean, part binary")
    sorted_ = in_arrow(parts.repartition("name").sortWithinPartitions("name"), sort, f"doc {doc_type}, tie long, low long, high long")
    first = F.shiftright("spot", 16)
    last = F.col("spot").bitwiseAND(F.lit(255))
    whole = judged.where("whole").select("doc", "tie", first.alias("low"), (first + last + WIDTH).alias("high"))
    return whole.unionByName(sorted_).withColumnRenamed("doc", key)


def merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept", spans: str = "spans") -> DataFrame:
    """All rows and columns of `docs`, with `kept` (the remaining bytes) and `spans` (removed byte ranges).

    A column of `docs` that has one of these two names gives way; name them otherwise to keep it.
    """
    names = [c for c in docs.columns if c not in (kept, spans)]
    k, t, own, data, found = unused(docs, "k", "t", "own", "data", "found")
    ranges = repeats(docs.select(key, text), key, text)
    ranges = ranges.groupBy(F.col(key).alias(k), F.col("tie").alias(t)).agg(F.collect_set(F.struct("low", "high")).alias(found))
    base = docs.select(*names, F.xxhash64(text).alias(own), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(data))
    joined = base.join(ranges, F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(t)), "left").select(*names, data, found)
    schema = docs.select(*names).withColumns({kept: F.lit(b""), spans: F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))}).schema
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names) + 1)
            sizes, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
            low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
            left, removed, at = [], [], 0
            for value, n in zip(batch.column(len(names)), sizes.tolist(), strict=True):
                data = value.as_py()
                gone = merged(low[at : at + n].tolist(), high[at : at + n].tolist())
                at += n
                ends = [0, *(b for _, b in gone)]
                left.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)], strict=True)))
                removed.append([{"low": a, "high": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(left, pa.binary()), pa.array(removed, kind)], schema.names)

    return in_arrow(joined, run, schema)


@F.pandas_udf(StringType())
def as_text(kept: pd.Series) -> pd.Series:
    """Bytes as text, without the parts of characters that were cut in two."""
    return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    found = strip(docs.select(key, text), key, text)
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"])
    return found.select(key, n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
