"""Language identification by multilingual mixtures.

Each language has a distribution over hashed letter trigrams (words are bounded
by blanks). The trigrams of a document are taken as drawn from a mixture of
these; expectation-maximisation estimates the proportions. The set of languages
is built up from the likeliest one: a language is added only if the
log-likelihood rises by more than a penalty of the Bayesian information
criterion. The derivative of the log-likelihood towards a language bounds what
it can add (the log-likelihood is concave), so most documents need no
second estimate, without loss.

Null texts and texts without a letter are `und` with score 0. Ties go to the
language first in order. With nothing to learn from, all is `und`. Texts of any
length count whole; equal rows have equal results; rows without an id are handled
like any, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, in_arrow

BUCKETS = 1 << 14
#: Documents of each language that the distributions are fitted on (about).
SAMPLE_PER_LANGUAGE = 3000
SMOOTHING = 0.5
STEPS = 25
UNKNOWN = "und"
#: Share that a document's main language has at least, to be kept by `keep_identified`.
LEAST_SHARE = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a text and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The languages in order and their distributions (buckets x languages).

    Learns from rows that have both text and language; at most about
    `per_language` documents of each, chosen by a hash of the id.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    chosen = bounded_sample(known, "l", per_language, "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = trigram_counts(t)
                sums.setdefault(name, np.zeros(BUCKETS))[at] += n
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["l", "bucket", "n"])

    parts = in_arrow(chosen.select("t", "l"), count, "l string, bucket int, n double")
    rows = parts.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    names = sorted(rows["l"].unique())
    theta = np.full((BUCKETS, len(names)), SMOOTHING)
    for j, name in enumerate(names):
        one = rows[rows["l"] == name]
        theta[one["bucket"].to_numpy(), j] += one["n"].to_numpy()
    return names, theta / theta.sum(axis=0, keepdims=True) if names else theta


def _estimate(counts: np.ndarray, theta: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation, and the mixed probabilities."""
    share, total = start, counts.sum()
    for _ in range(STEPS):
        new = share * ((counts / (theta @ share)) @ theta) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, theta @ share


def mixture(text: str | None, theta: np.ndarray) -> np.ndarray | None:
    """Proportions of the languages in a text (zero: not in the chosen set); None without a letter."""
    at, counts = trigram_counts(text or "")
    n_langs = theta.shape[1]
    if not len(at) or not n_langs:
        return None
    here = theta[at]
    single = counts @ np.log(here)
    chosen = [int(np.argmax(single))]
    share, mixed, best, total = np.ones(1), here[:, chosen[0]], single[chosen[0]], counts.sum()
    penalty = 0.5 * np.log(max(total, 2.0)) + 1.0
    while len(chosen) < n_langs:
        gain = (counts / mixed) @ here - total
        gain[chosen] = -np.inf
        other = int(np.argmax(gain))
        if gain[other] <= penalty:
            break
        start = np.append(share * 0.8, 0.2)
        new, new_mixed = _estimate(counts, here[:, [*chosen, other]], start)
        value = counts @ np.log(new_mixed)
        if value - best <= penalty:
            break
        chosen.append(other)
        share, mixed, best = new, new_mixed, value
    out = np.zeros(n_langs)
    out[chosen] = share
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (its proportion) and the proportions of all chosen languages as a map."""
    names, theta = model
    shared = docs.sparkSession.sparkContext.broadcast(theta)  # buckets x languages
    schema = docs.select(key).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "proportions": F.create_map(F.lit(""), F.lit(0.0))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = shared.value
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            langs, scores, parts = [], [], []
            for value in batch.column(1):
                share = mixture(value.as_py(), theta)
                best = None if share is None else int(np.argmax(share))
                langs.append(UNKNOWN if best is None else names[best])
                scores.append(0.0 if best is None else min(1.0, float(share[best])))
                parts.append([] if best is None else [(names[j], float(share[j])) for j in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(parts, kind)], schema.names)

    return in_arrow(docs.select(key, text), run, schema)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", lang: str = "lang", least: float = LEAST_SHARE) -> DataFrame:
    """The rows of `docs` that have a main language, which becomes their `lang`.

    Rejected are texts that are `und`, and mixtures in which no language has a share of `least`.
    All columns stay; `lang` is filled or corrected, where `docs` has that column.
    """
    names, theta = model
    shared = docs.sparkSession.sparkContext.broadcast(theta)
    place = docs.columns.index(lang) if lang in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = shared.value
        for batch in batches:
            shares = [mixture(t.as_py(), theta) for t in batch.column(text)]
            keep = [s is not None and s.max() >= least for s in shares]
            columns = list(batch.columns)
            if place is not None:
                columns[place] = pa.array([names[int(np.argmax(s))] if k else None for s, k in zip(shares, keep, strict=True)], pa.string()).cast(batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
