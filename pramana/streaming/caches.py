"""Caches of what costs much to make (readings, translations, privacy checks, audio), kept by content.

An entry is known by the digest of what it was made from, a language and the version
of the rules. Entries lie in buckets of their digests; new ones are added, never
changed, and the newest that has not expired counts. `fill` makes only what is
missing: the keys that are asked for meet the cache without the texts, and the
texts are read for missing keys alone, if there are any.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

KEY = ["digest", "lang"]


class ContentCache:
    """value_type: string for texts, binary for audio. days: how long an entry counts (None: always)."""

    def __init__(self, spark: SparkSession, path: str, version: int, value_type: str = "string", days: int | None = None, buckets: int = 16):
        self.spark, self.path, self.version, self.days, self.buckets = spark, path.rstrip("/"), version, days, buckets
        self.schema = f"digest string, lang string, version int, value {value_type}, made date, bucket int"

    def entries(self, today: datetime.date) -> DataFrame:
        """digest, lang and value of the entries that count on a day: of one key, the one made last."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema).select(*KEY, "value")
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("version") == self.version)
        if self.days is not None:
            rows = rows.where(F.date_add("made", self.days) > F.lit(today))
        return rows.groupBy(*KEY).agg(F.max_by("value", F.struct("made", "value")).alias("value"))

    def missing(self, asked: DataFrame, today: datetime.date) -> DataFrame:
        """The different keys (digest, lang) that are asked for and not there."""
        return asked.select(*KEY).where("digest IS NOT NULL AND lang IS NOT NULL").distinct().join(self.entries(today).select(*KEY), KEY, "left_anti")

    def fill(self, asked: DataFrame, make: Callable[[DataFrame], DataFrame], today: datetime.date) -> int:
        """Makes what is missing: make(keys) gives (digest, lang, value). How many entries were added; `make` is not called for none."""
        keys = written(self.missing(asked, today), "missing")
        n = keys.count()
        if n:
            made = make(keys).select("digest", "lang", F.lit(self.version).cast("int").alias("version"), "value", F.lit(today).alias("made"), F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int").alias("bucket"))
            made.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n

    def lookup(self, asked: DataFrame, today: datetime.date) -> DataFrame:
        """`asked` with the cached value, null where there is none."""
        return asked.join(self.entries(today), KEY, "left")


def digest(content: Column) -> Column:
    """The name of a content."""
    return F.sha2(content.cast("binary"), 256)
