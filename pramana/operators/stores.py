"""Stores of saved results as tables: upserts, patches, cascades, look-ups, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed import newest

MOST_RESULTS, MOST_ASKS = 20, 40


def upserted(saved: DataFrame, new: DataFrame, by: str, key: str, order: str, most: int = MOST_RESULTS) -> DataFrame:
    """`saved` with the rows of `new`, which replace rows of their key; each owner keeps the newest."""
    kept = saved.join(new.select(by, key), [by, key], "left_anti")
    return newest(kept.unionByName(new), [by], [F.col(order).desc(), F.col(key)], most)


def asks_appended(asks: Column, new: Column, most: int = MOST_ASKS) -> Column:
    """Turns with new ones behind them; the last ones stay."""
    all_ = F.concat(F.coalesce(asks, F.slice(new, 1, 0)), new)
    return F.slice(all_, F.greatest(F.size(all_) - most + 1, F.lit(1)), most)


def translation_put(translations: Column, lang: Column, value: Column) -> Column:
    """A map of translations with one set or replaced."""
    put = F.map_from_arrays(F.array(lang), F.array(value))
    return F.map_concat(F.map_filter(F.coalesce(translations, F.map_filter(put, lambda k, v: F.lit(False))), lambda k, v: k != lang), put)


def cascaded(stores: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every store without the rows of the deleted results."""
    ids = gone.select(key)
    return {name: rows.join(ids, key, "left_anti") for name, rows in stores.items()}


def append_feedback(rows: DataFrame, path: str) -> None:
    """Add feedback rows to a table of Parquet files; earlier rows stay."""
    rows.write.mode("append").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key of a Parquet table; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


def cached_readings(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (content, version, lang) with the cached value of sha256:version in that language, null where there is none."""
    keyed = asked.withColumn("cache_key", F.concat_ws(":", F.sha2("content", 256), F.col("version").cast("string")))
    once = cache.groupBy("cache_key", "lang").agg(F.max("value").alias("value"))
    return keyed.join(once, ["cache_key", "lang"], "left")


def files_digest(files: DataFrame, by: str) -> DataFrame:
    """One SHA-256 for the files (pos, content) of each upload, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("content").alias("h")))), lambda x: x["h"])
    return files.groupBy(by).agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("digest"))


def sample_results(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file, lang) with the body in that language, else in English: bodies (file, lang, body) must be JSON objects with a title."""
    fine = bodies.where(F.trim("body").startswith("{") & (F.coalesce(F.get_json_object("body", "$.title"), F.lit("")) != ""))
    own = fine.select("file", "lang", F.col("body").alias("own"))
    english = fine.where("lang = 'en'").select("file", F.col("body").alias("english"))
    found = wanted.join(own, ["file", "lang"], "left").join(english, "file", "left")
    shown = F.when(F.col("own").isNotNull(), F.col("lang")).when(F.col("english").isNotNull(), "en")
    return found.select("file", "lang", F.coalesce("own", "english").alias("body"), shown.alias("shown_lang"))
