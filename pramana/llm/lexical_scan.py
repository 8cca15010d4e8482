"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

All terms of the items go into one automaton. A term is guarded by a blank on
both sides, and in a text every byte that is no part of a term is turned into a
blank first, so each hit is a whole term. One pass over a text gives the number
of its terms and, for each item term in it, how often it occurs. Document
frequencies are sums over these counts; a second pass over the counts (not the
texts) takes the automaton's outputs to the items that hold the term, and adds
their weights in whole numbers. Each task keeps the best `k` of its documents
for each item, and groups of tasks merge theirs before the last choice.

Items are taken in parts whose terms have about PART_BYTES, one scan of the
documents for each, so what is sent to the tasks is bounded however many items
there are (the terms of one item stay together).

A null or empty text, or one without a term, is in no result and counts in no
statistic. An item without terms, or whose terms no document holds, has no rows;
items that share an id count as one item with the terms of all, and items without
an id are left out. Documents that share an id are documents of their own; among
equal scores and ids either may come first. Documents without an id rank behind
all others of their score. Empty tables give an empty result. Other columns, of
any name, are not looked at. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise, unused

#: Bytes of the terms of a part of the items: what is sent to every task at a time.
PART_BYTES = 1 << 20
#: Documents whose scores are added up at a time, and scores at most.
BLOCK, BLOCK_SCORES = 64, 1 << 21
#: Tasks' choices for an item are merged in so many groups first.
SALTS = 64

# ASCII bytes that are part of a term; all above are.
_PART = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _PART else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and a blank for each byte outside of terms."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) without repeats; terms as in documents."""
    schema = items.select(F.col(key).cast("long").alias("item")).withColumn("term", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(folded(x.as_py()).split())) for x in batch.column(1)]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([t for x in found for t in x], pa.binary())], schema.names)

    return in_arrow(items.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text), run, schema).distinct()


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds every term between blanks; its output is the term's number. Bytes stand for themselves (Latin-1)."""
    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term.decode('latin-1')} ", number)
    if terms:
        made.make_automaton()
    return made


def count_terms(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, np.ndarray, np.ndarray]:
    """Terms of a text with repeats, the numbers of the machine's terms in it, and how often each occurs."""
    plain = folded(text)
    n = len(plain.split())
    if not n or not len(machine):
        return n, np.empty(0, np.int64), np.empty(0, np.int64)
    hits = np.fromiter((number for _, number in machine.iter(f" {plain.decode('latin-1')} ")), np.int64)
    return n, *np.unique(hits, return_counts=True)


def scan(docs: DataFrame, terms: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key as doc, n (terms with repeats), numbers and tfs (arrays) for each document with a term."""
    schema = docs.select(F.col(key).alias("doc")).withColumns({"n": F.lit(0).cast("long"), "numbers": F.array().cast("array<int>"), "tfs": F.array().cast("array<int>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for batch in batches:
            keep, counts, numbers, tfs = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                n, number, tf = count_terms(value.as_py(), machine)
                if n:
                    keep.append(i)
                    counts.append(n)
                    numbers.append(number.astype(np.int32))
                    tfs.append(tf.astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(counts, pa.int64()), pa.array(numbers, ints), pa.array(tfs, ints)], schema.names)

    return in_arrow(docs.select(key, text), run, schema)


def _best_scores(hits: DataFrame, n_docs: int, n_terms: int, postings: np.ndarray, k: int) -> DataFrame:
    """item, doc, score: for each item the k best documents of each task. `postings` has rows (item, term number, weight)."""
    postings = postings[np.argsort(postings[:, 1], kind="stable")]
    items, slot = np.unique(postings[:, 0], return_inverse=True)
    numbers, first, many = np.unique(postings[:, 1], return_index=True, return_counts=True)
    weight, step = postings[first, 2], max(1, min(BLOCK, BLOCK_SCORES // len(items)))
    schema = "item long, doc long, score long"

    def scores(n: np.ndarray, owner: np.ndarray, number: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Documents by items."""
        out = np.zeros((len(n), len(items)), np.int64)
        at = np.searchsorted(numbers, number).clip(0, len(numbers) - 1)
        m = 10 + (90 * n[owner] * n_docs) // n_terms
        part = weight[at] * ((10**9 * tf) // (1000 * tf + 8 * m))
        reps = many[at]
        flat = np.repeat(first[at] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        np.add.at(out, (np.repeat(owner, reps), slot[flat]), np.repeat(part, reps))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((0, 4), np.int64)  # slot of the item, score, document, whether it has an id
        least = np.ones(len(items), np.int64)  # a score below has k better ones in this task

        def merged(rows: np.ndarray) -> np.ndarray:
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], -rows[:, 1], rows[:, 0]))]
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            least[rows[place == k - 1, 0]] = rows[place == k - 1, 1]
            return rows[place < k]

        for batch in batches:
            known = np.asarray(batch.column(0).is_valid()).astype(np.int64)
            doc, n = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.asarray(batch.column(2).offsets).astype(np.int64)
            number, tf = (np.asarray(c.values).astype(np.int64) for c in batch.columns[2:])
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                cut = slice(ends[a], ends[b])
                got = scores(n[a:b], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), number[cut], tf[cut])
                row, item = np.nonzero(got >= least)
                if len(row):
                    best = merged(np.concatenate([best, np.stack([item, got[row, item], doc[a:b][row], known[a:b][row]], axis=1)]))
        yield pa.RecordBatch.from_arrays([pa.array(items[best[:, 0]]), pa.array(best[:, 2], mask=best[:, 3] == 0), pa.array(best[:, 1])], ["item", "doc", "score"])

    return in_arrow(hits.select("doc", "n", "numbers", "tfs"), run, schema)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """item_key, rank (from 1), key and score of the k best documents of each item; keys are whole numbers."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    pairs = materialise(item_terms(items, item_key, item_text), "item-terms")
    n_bytes = pairs.agg(F.sum(F.octet_length("term")).alias("n")).first()["n"] or 0
    parts, sums, best, spent = max(1, -(-n_bytes // part_bytes)), None, None, pairs
    for part in range(parts):
        mine = [(r["item"], bytes(r["term"])) for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]
        number = {term: i for i, term in enumerate(sorted({term for _, term in mine}))}
        if not mine:
            continue
        hits = materialise(scan(rows, list(number), "doc", "text"), "hits")
        if sums is None:
            sums = hits.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = sums["docs"], sums["terms"] or 0
        found = hits.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df")).collect()  # a row for each term of the part
        weight = {r["number"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
        postings = [(item, number[term], weight[number[term]]) for item, term in mine if number[term] in weight]
        if postings:
            best = materialise(_best_scores(hits, n_docs, n_terms, np.array(postings, np.int64), k).unionByName(best or _none(rows)), "best", *([hits, spent] if parts == 1 else [hits]))
    best = _none(rows) if best is None else best
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = best.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    doc_name = unused(items.select(item_key), key)[0]
    return last.select(F.col("item").cast(items.schema[item_key].dataType).alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_name), "score")


def _none(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "item long, doc long, score long")
