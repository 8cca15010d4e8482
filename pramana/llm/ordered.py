"""Rows in ascending id order over many partitions, without one task that sees all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow

#: Bytes of text in a range, about; there are at least as many ranges as input partitions.
RANGE_BYTES = 32 << 20
FINE = 8  # quantiles of the id for each range: what ranges of about equal bytes are put together from
LEAST = np.iinfo(np.int64).min


def boundaries(df: DataFrame, key: str, text: str | None = None, range_bytes: int = RANGE_BYTES) -> np.ndarray:
    """Ids that cut `df` into ranges of about equal bytes of `text` (of equal rows, where none is named).

    Two passes read ids and lengths only; a row for each fine range comes to the driver.
    """
    parts = max(1, df.rdd.getNumPartitions())
    if text is not None:
        total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
        parts = max(parts, -(-total // range_bytes))
    if parts == 1:
        return np.empty(0, np.int64)
    n = parts * (1 if text is None else FINE)
    fine = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    fine = np.unique(np.array(fine)).astype(np.int64)
    if text is None or not len(fine):
        return fine
    sized = with_range(df.select(key, F.octet_length(text).cast("string").alias("n")), key, "n", fine)
    found = {r["part"]: r["n"] for r in sized.groupBy("part").agg(F.sum(F.col("text").cast("long")).alias("n")).collect()}
    ends = np.cumsum([found.get(i) or 0 for i in range(len(fine) + 1)])
    whole = np.minimum((ends - 1).clip(0) * parts // max(1, int(ends[-1])), parts - 1)  # the range that a fine range ends in
    return fine[whole[1:] != whole[:-1]]


def with_range(df: DataFrame, key: str, text: str, cuts: np.ndarray) -> DataFrame:
    """key, text, part (number of its range; rows without a key are in the first) and tie (orders rows that share a key)."""
    schema = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumns({"part": F.lit(0), "tie": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(LEAST).to_numpy()
            part = np.searchsorted(cuts, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part), batch.column(2)], schema.names)

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    return in_arrow(chosen, run, schema)


def _places(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions, a number that Spark's hash partitioning sends there (or the partition's number)."""
    i = F.col("id").cast("int")
    found = spark.range(40 * n).groupBy(F.pmod(F.hash(i), F.lit(n)).alias("at")).agg(F.min("id").alias("i")).collect()
    by = {r["at"]: r["i"] for r in found}
    return [by.get(p, p) for p in range(n)]


def dealt(ranged: DataFrame, n_parts: int, *order: str) -> DataFrame:
    """Each range in one partition of its own, sorted."""
    place = F.get(F.lit(np.array(_places(ranged.sparkSession, n_parts), np.int32)), F.col("part"))
    return ranged.withColumn("place", place).repartition(n_parts, "place").drop("place").sortWithinPartitions("part", *order)


def first_keys(df: DataFrame, key: str, cuts: np.ndarray) -> dict[int, int]:
    """The least key of each range that has rows: one row for each range."""
    ranged = with_range(df.select(key).withColumn("none", F.lit("")), key, "none", cuts)
    return {r["part"]: r["k"] for r in ranged.groupBy("part").agg(F.min("key").alias("k")).collect()}
