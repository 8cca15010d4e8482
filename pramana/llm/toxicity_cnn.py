"""Toxicity: a convolutional text classifier, trained in numpy.

Words are lower-cased runs of letters and digits. A word's embedding is the sum
of two hashed rows: its own and that of its first letters, so inflected forms
share what they have learnt. Filters of several widths slide over the words; each is max-pooled over
the whole document, and a logistic layer reads the pooled values. Training
passes gradients through the pooled positions only. All labelled rows are learnt
from: they lie in shards of about SHARD_ROWS, chosen by a hash of the id. In each
epoch a task goes through a shard from the same model on; what the shards changed
is averaged (a word's row over those that changed it), and only that comes to the
driver, which sees no rows. At scoring time the
embedding table is multiplied by the filters once, so a document is scored by
table look-ups.

Thresholds are calibrated for each language on rows kept out of training. The
score never uses the language; only the `flagged` column of `score` does.

Null texts count as empty. Empty texts get the score of a document without any
active filter. With labels of one class only, or none, every score is the share
of toxic labels (0 without labels). A document with several labels counts as
toxic if one of them says so; rows without an id have no label, and are scored
like any. Repeated rows are scored each, texts of any length as a whole. An empty
table gives an empty result. Other columns, of any name, are not looked at.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, likely_in, materialise
from .ordered import dealt

BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Labelled rows that one task goes through in an epoch (about), and words of a batch at most (but for one longer text).
SHARD_ROWS, BATCH_WORDS = 8192, 1 << 19
#: Rows of the embedding table that are averaged together.
PART_ROWS = 2048
STEM = 4
MEMO_WORDS = 400_000
_WORD = re.compile(r"\w+")


def _row(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % (BUCKETS - 1) + 1


class _Hashes(dict):
    """Word to its two rows of the embedding table, packed in one number; row 0 is blank."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        stem = _row(f"{word[:STEM]}*") if len(word) > STEM else 0
        self[word] = found = _row(word) << 16 | stem
        return found


_hashes = _Hashes()


def word_rows(text: str | None) -> np.ndarray:
    """Packed rows of the words of a text, with blanks behind so that every filter fits."""
    words = _WORD.findall((text or "").lower())
    out = np.zeros(len(words) + WIDTHS[-1], np.uint32)
    out[: len(words)] = np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))
    return out


@dataclass
class Model:
    """Embeddings, filters, output layer, and thresholds by language."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def taps(self) -> np.ndarray:
        """What each row adds at each tap of each filter: rows x (taps * filters)."""
        return np.concatenate([self.table @ self.filters[w][k] for w in WIDTHS for k in range(w)], axis=1).astype(np.float32)

    def scores(self, rows: list[np.ndarray], taps: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each document."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        logits = np.concatenate([_pool(x, taps)[None] for x in rows]) @ self.weights + self.bias
        return 1 / (1 + np.exp(-logits))


#: Words handled at a time: bounds the memory for very long documents.
CHUNK = 1 << 16


def _pool(ids: np.ndarray, taps: np.ndarray) -> np.ndarray:
    best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    for start in range(0, len(ids) - WIDTHS[-1] + 1, CHUNK):
        part = ids[start : start + CHUNK + WIDTHS[-1] - 1]
        found = taps[part >> 16] + taps[part & 0xFFFF]
        at, n = 0, len(found) - WIDTHS[-1] + 1
        for j, w in enumerate(WIDTHS):
            total = found[:n, at : at + FILTERS]
            for k in range(1, w):
                total = total + found[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += w * FILTERS
            part = best[j * FILTERS : (j + 1) * FILTERS]
            np.maximum(part, total.max(axis=0), out=part)
    return best


class _Training:
    """What training carries from batch to batch: the parameters, and the sums that set their steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        table[0] = 0
        self.words = np.concatenate([table, np.full((BUCKETS, 1), 1e-8, np.float32)], axis=1)  # embeddings, and their squared gradients
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        params = [rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32), *filters]
        self.shapes = [p.shape for p in params]
        flat = np.concatenate([p.ravel() for p in params])
        self.rest = np.concatenate([flat, np.zeros(2 * len(flat) + 1, np.float32)])  # parameters, their two moments, steps

    def views(self) -> list[list[np.ndarray]]:
        """Parameters (weights, bias, filters), first and second moments, as parts of `rest`."""
        ends = np.cumsum([int(np.prod(x)) for x in self.shapes] * 3)
        parts = np.split(self.rest[:-1], ends[:-1])
        n = len(self.shapes)
        return [[x.reshape(d) for x, d in zip(parts[i : i + n], self.shapes, strict=True)] for i in (0, n, 2 * n)]

    def model(self) -> Model:
        (weights, bias, *filters), *_ = self.views()
        return Model(self.words[:, :DIM], dict(zip(WIDTHS, filters, strict=True)), weights, float(bias[0]))

    def learn(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """A step of Adam on the pooled positions of a batch."""
        params, first, second = self.views()
        weights, bias, *kernels = params
        table, squares = self.words[:, :DIM], self.words[:, DIM]
        ids = np.concatenate(rows)
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
        both = np.stack([ids >> 16, ids & 0xFFFF])
        local = table[both[0]] + table[both[1]]
        pooled, where = [], []
        for w, filters in zip(WIDTHS, kernels, strict=True):
            total = np.zeros((len(ids), FILTERS), np.float32)
            for k in range(w):
                total[: len(ids) - k] += local[k:] @ filters[k]
            top = np.maximum.reduceat(total, starts, axis=0)
            spot = np.empty_like(top, dtype=np.int64)
            for d, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                spot[d] = a + total[a:b].argmax(axis=0)
            pooled.append(np.maximum(top, 0))
            where.append(spot)
        features = np.concatenate(pooled, axis=1)
        odds = 1 / (1 + np.exp(-(features @ weights + bias)))
        error = ((odds - labels) / len(rows)).astype(np.float32)
        back = error[:, None] * weights[None] * (features > 0)
        grads = [features.T @ error + 1e-4 * weights, error.sum(keepdims=True)]
        spots, steps = [], []
        for j, (w, filters) in enumerate(zip(WIDTHS, kernels, strict=True)):
            g, kernel = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(filters)
            for k in range(w):
                at = np.minimum(where[j] + k, len(ids) - 1)
                kernel[k] = np.einsum("dfe,df->ef", local[at], g)
                spots.append(both[:, at].reshape(2, -1))
                steps.append((g[:, :, None] * filters[k].T[None]).reshape(-1, DIM))
            grads.append(kernel + 1e-4 * filters)
        self.rest[-1] += 1
        step = self.rest[-1]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        words, inverse = np.unique(np.concatenate(spots, axis=1), return_inverse=True)
        touched = np.zeros((len(words), DIM), np.float32)
        np.add.at(touched, inverse.reshape(2, -1), np.concatenate(steps)[None])
        squares[words] += (touched**2).mean(axis=1)
        table[words] -= 0.05 * touched / np.sqrt(squares[words])[:, None]
        table[0] = 0


_CHANGES = pa.schema([("at", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("change", pa.binary())])


def _changes(start: _Training, now: _Training, part: int, n: int) -> pa.RecordBatch:
    """What a shard's n rows changed: rows of words by their place, then (-1) the rest."""
    words = now.words - start.words
    made = [(at, words[at : at + PART_ROWS]) for at in range(0, BUCKETS, PART_ROWS)] + [(-1, now.rest - start.rest)]
    made = [{"at": at, "part": part, "n": n, "change": x.tobytes()} for at, x in made]
    return pa.RecordBatch.from_pylist(made, _CHANGES)


def _averaged(found: pa.Table) -> pa.Table:
    """The mean of the shards' changes at one place, in the order of the shards: of words over those that changed them, of the rest by their rows."""
    found = found.sort_by([("part", "ascending"), ("n", "ascending")])
    total, weight, words = 0.0, 0.0, found["at"][0].as_py() >= 0
    for n, change in zip(found["n"].to_pylist(), found["change"], strict=True):
        x = np.frombuffer(change.as_buffer(), np.float32).astype(np.float64)
        x = x.reshape(-1, DIM + 1) if words else x
        mine = (x[:, DIM:] > 0).astype(np.float64) if words else float(n)
        total, weight = total + x * mine, weight + mine
    mean = (total / np.maximum(weight, 1)).astype(np.float32)
    return pa.table({"at": found["at"][:1], "change": pa.array([mean.tobytes()], pa.binary())})


def _epoch(shards: DataFrame, start: _Training) -> _Training:
    """The model after all shards (rows of part, y and rows, those of a shard one after the other) were gone through once."""
    sent = shards.sparkSession.sparkContext.broadcast(start)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, rows, labels, n, size = None, None, [], [], 0, 0

        def step() -> None:
            if rows:
                now.learn(rows, np.array(labels, np.float32))
            rows.clear(), labels.clear()

        for batch in batches:
            for at, y, row in zip(*(batch.column(i) for i in range(3)), strict=True):
                if at.as_py() != part:
                    if now is not None:
                        step()
                        yield _changes(sent.value, now, part, n)
                    part, now, n, size = at.as_py(), copy.deepcopy(sent.value), 0, 0
                row = np.frombuffer(row.as_py(), np.uint32)
                if len(rows) == BATCH or size + len(row) > BATCH_WORDS:
                    step()
                    size = 0
                rows.append(row), labels.append(y.as_py())
                n, size = n + 1, size + len(row)
        if now is not None:
            step()
            yield _changes(sent.value, now, part, n)

    changes = in_arrow(shards.select("part", "y", "rows"), run, "at int, part int, n long, change binary")
    now = copy.deepcopy(start)
    for r in changes.groupBy("at").applyInArrow(_averaged, "at int, change binary").collect():  # as large as the model
        change = np.frombuffer(r["change"], np.float32)
        if r["at"] < 0:
            now.rest += change
        else:
            now.words[r["at"] : r["at"] + PART_ROWS] += change.reshape(-1, DIM + 1)
    sent.destroy()
    return now


def _thresholds(aside: DataFrame, model: Model) -> dict[str, float]:
    """For each language, the score (a multiple of 0.001) from which on rows are flagged with the best F1; a row for each language, label and multiple comes to the driver."""
    sent = aside.sparkSession.sparkContext.broadcast((model, model.taps()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, taps = sent.value
        for batch in batches:
            scores = [int(model.scores([np.frombuffer(x.as_py(), np.uint32)], taps)[0] * 1000) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int32())], ["l", "y", "s"])

    kind = aside.select("l", "y").withColumn("s", F.lit(0)).schema
    counts: dict = {}
    for r in in_arrow(aside.where("l IS NOT NULL").select("l", "y", "rows"), run, kind).groupBy("l", "y", "s").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["l"], np.zeros((2, 1001), np.int64))[int(r["y"] != 0), r["s"]] += r["n"]
    found = {}
    for name, n in sorted(counts.items()):
        if n.sum(axis=1).min() >= 5:
            flagged = n[:, ::-1].cumsum(axis=1)[:, ::-1]  # by score: rows of each label from it on
            f1 = np.where(n.any(axis=0), 2 * flagged[1] / (flagged.sum(axis=0) + flagged[1, 0]).clip(1), -1)
            found[name] = int(np.argmax(f1)) / 1000
    return found


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", shard_rows: int = SHARD_ROWS) -> Model:
    """Train on all labelled rows, but for a fifth, which sets the thresholds by language and trains nothing."""
    marks = labels.where(F.col(label).isNotNull()).select(F.col(key).cast(docs.schema[key].dataType).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    blank = Model(np.zeros((1, 1)), {}, np.zeros(1), 0.0, constant=sizes.get(1, 0) / total if total else 0.0)
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 10:
        return blank
    n_shards = -(-total // shard_rows)
    texts = likely_in(docs.select(docs[text].alias("t"), docs[lang].alias("l"), docs[key].alias("k")), marks, ["k"])  # other texts are not shuffled
    found = texts.join(marks.hint("merge"), "k").select("t", "l", "k", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([word_rows(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([made, *batch.columns[1:]], ["rows", "l", "k", "y"])

    kind = docs.select(F.lit(b"").alias("rows"), F.col(lang).alias("l"), F.col(key).alias("k"), F.lit(0).alias("y")).schema
    place = F.xxhash64("k")
    rows = in_arrow(found, hashed, kind).select(F.pmod(place, F.lit(n_shards)).cast("int").alias("part"), "y", "rows", "l", place.alias("place"), (F.crc32(F.concat(F.lit("aside "), F.col("k").cast("string")).cast("binary")) % 5 == 0).alias("aside"))
    rows = materialise(dealt(rows, n_shards, "place", "rows"), "labelled")
    shards = rows.where(~F.col("aside"))
    if shards.agg(F.count_distinct("y")).first()[0] < 2:
        return blank
    training = _Training()
    for _ in range(EPOCHS):
        training = _epoch(shards, training)
    model = training.model()
    model.thresholds.update(_thresholds(rows.where("aside"), model))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, score, and flagged: the score reaches the threshold of the row's language (0.5 where none is set)."""
    taps = docs.sparkSession.sparkContext.broadcast((model, model.taps() if model.constant is None else None))  # a fixed size
    schema = docs.select(F.col(key)).withColumns({"score": F.lit(0.0), "flagged": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = taps.value
        for batch in batches:
            found = [float(model.scores([word_rows(t.as_py())], table)[0]) for t in batch.column(1)]
            flags = [s >= model.thresholds.get(n.as_py(), 0.5) for s, n in zip(found, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(flags, pa.bool_())], schema.names)

    return in_arrow(docs.select(key, text, lang), run, schema)
