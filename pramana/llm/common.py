"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about, where the session sets no bound of its own: a batch of long texts stays small.
BATCH_BYTES = 4 << 20
#: Bits of what stands for the members of a table in `likely_in`: 8 MB.
MEMBER_BITS = 1 << 26
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a local one where none is set (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="pramana-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by bytes, not by rows alone."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def materialise(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back.

    The written files survive the loss of any executor. `spent`: tables made by this
    function that nothing reads once this one is written; their files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for table_ in spent:
        old = spark._jvm.org.apache.hadoop.fs.Path(table_._written)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def likely_in(rows: DataFrame, members: DataFrame, by: list[str], bits: int = MEMBER_BITS) -> DataFrame:
    """The rows whose columns `by` may be those of a member: all that are, and few others. What goes to the tasks are `bits` bits at most, so their join is left with few rows."""
    bit = F.pmod(F.xxhash64(*by), F.lit(bits))
    bucket, place = F.floor(bit / 32768), F.pmod(bit, F.lit(32768))
    maps = members.select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    marked = rows.withColumns({"bucket": bucket, "place": place}).join(F.broadcast(maps), "bucket")  # a row of 4 KB for each 32,768 bits
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(byte.bitwiseAND(F.element_at(F.lit([1 << i for i in range(8)]), (F.pmod("place", F.lit(8)) + 1).cast("int"))) != 0).select(*rows.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until `df` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: how rows are split for learning."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, by: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """About `per_value` rows for each value of `by`, chosen by a hash of `key`.

    Only the group sizes come to the driver (one row for each class or language).
    The same rows are chosen on every run. Used for fitting classifiers only.
    """
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    keep = F.lit(False)
    for value, n in sizes.items():
        if value is not None:
            keep = keep | ((F.col(by) == F.lit(value)) & (draw < F.lit(min(1.0, per_value / n))))
    return df.where(keep)
