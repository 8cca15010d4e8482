"""Byte-level BPE encoding with a segment tree, and decoding.

Each piece that the split pattern finds is a row of bytes. A segment tree over
its byte positions keeps, in each node, the least (rank, position) of the pairs
below it, so the root names the leftmost pair of minimum rank. A merge changes
at most three leaves (the pair itself, the right part, the left neighbour), each
a logarithmic update; dead positions hold no pair.

Null and empty texts give no ids. Repeated rows and extra columns are kept as
they are, rows without an id too; a piece of any length costs n log n. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Pieces remembered by a worker before it starts afresh: bounds its memory.
MEMO_PIECES = 400_000
_NONE = 1 << 62


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file with base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    if not n:
        return []
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    end = list(range(1, n + 1))  # end[i]: where the live token that starts at i ends
    before = list(range(-1, n))  # before[i]: start of the live token to the left

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def pair(i: int, stop: int) -> int:
        rank = ranks.get(piece[i:stop])
        return _NONE if rank is None else rank << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        right = end[i]
        stop = end[right]
        end[i] = stop
        before[stop] = i
        put(right, _NONE) if right < n - 1 else None
        put(i, pair(i, end[stop]) if stop < n else _NONE)
        if (left := before[i]) >= 0:
            put(left, pair(left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Memo(dict):
    """Piece to its ids as decimal text; unknown pieces are merged on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> str:
        if len(self) >= MEMO_PIECES:
            self.clear()
        self[piece] = found = " ".join(map(str, merge_piece(piece.encode(), self.ranks)))
        return found


@lru_cache(maxsize=4)
def _coder(path: str, pattern: str):
    ranks = load_ranks(path)
    return regex.compile(pattern).findall, _Memo(ranks), {str(rank): token for token, rank in ranks.items()}


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """The ids of one text."""
    split, memo, _ = _coder(path, pattern)
    return [int(i) for piece in split(text) for i in memo[piece].split(" ")]


def decode_ids(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of a row of ids."""
    _, _, tokens = _coder(path, pattern)
    return b"".join(tokens[str(i)] for i in ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column of ids (array<int>) for each text; null text gives an empty array."""
    keep = [c for c in docs.columns if c != ids]
    schema = docs.select(*keep).withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([encode_text(t or "", path, pattern) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, ids])

    return in_arrow(docs.select(*keep), run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the bytes of each row of ids; null ids give empty bytes."""
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep).withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([decode_ids(x or [], path, pattern) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return in_arrow(docs.select(*keep), run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids again, and return counts and digests of both."""
    schema = docs.select(key).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo, tokens = _coder(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                ids = " ".join(map(memo.__getitem__, split(value.as_py() or "")))
                rows = ids.split(" ") if ids else []
                counts.append(len(rows))
                encoded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, rows))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], schema.names)

    return in_arrow(docs.select(key, text), run, schema)
