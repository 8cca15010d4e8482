"""Queries of caches and of bundled results that are built in several runs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch
from ..sources.tables import table
from ..streaming import builder
from ..streaming.caches import ContentCache, digest
from .registry import query


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN 'second: ' WHEN p_size % 2 = 0 THEN 'first: ' ELSE 'second: ' END || p_name || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'ta' ELSE 'hi' END AS value FROM part"
)
def cached_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the parts: sizes divisible by ten long ago, so that they have expired, then the even sizes, then all: each run makes only what is missing."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_partkey") % 3 == 0, "ta").otherwise("hi").alias("lang"))
    parts = parts.withColumn("digest", digest(F.concat_ws("|", "p_name", "p_size")))
    cache = ContentCache(spark, f"{scratch(spark, 'cache')}/translations", version=4, days=30)

    def make(run: str):
        texts = parts.select("digest", "lang", "p_name").distinct()
        return lambda keys: keys.join(texts, ["digest", "lang"]).withColumn("value", F.concat(F.lit(f"{run}: "), "p_name", F.lit("/"), "lang"))

    cache.fill(parts.where("p_size % 10 = 0"), make("old"), datetime.date(2026, 1, 1))
    cache.fill(parts.where("p_size % 2 = 0 AND p_size % 10 <> 0"), make("first"), datetime.date(2026, 5, 1))
    cache.fill(parts, make("second"), datetime.date(2026, 5, 20))
    return cache.lookup(parts, datetime.date(2026, 5, 20)).select("p_partkey", "value")


@query(
    "WITH s AS (SELECT DISTINCT p_brand || '-' || p_type AS file FROM part) SELECT file, l AS lang, CASE WHEN l = 'en' THEN '{\"title\": \"' || file || '\", \"fact\": \"' || file || '\"}' ELSE '{\"title\": \"' || l || '\"}' END AS body "
    "FROM s, (SELECT unnest(['en', 'ta', 'hi']) AS l) WHERE length(file) % 4 <> 0 AND (l <> 'hi' OR length(file) % 3 <> 0)"
)
def built_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of brands and types in three languages, built in two runs; English ones that lack their fact are rejected, and so are their translations and bodies without a title."""
    files = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_type").alias("file")).distinct()
    n, fact = F.length("file"), F.when(F.length("file") % 4 == 0, "nothing").otherwise(F.col("file"))
    english = files.select("file", F.lit("en").alias("lang"), F.concat(F.lit('{"title": "'), "file", F.lit('", "fact": "'), fact, F.lit('"}')).alias("body"))
    english = english.withColumn("body", F.when(n % 4 == 0, F.lit('{"title": "x", "fact": "nothing"}')).otherwise(F.col("body")))
    others = [files.select("file", F.lit(x).alias("lang"), F.when(F.lit(x == "hi") & (n % 3 == 0), '{"title": ""}').otherwise(F.lit('{"title": "' + x + '"}')).alias("body")) for x in ("ta", "hi")]
    answers, path = english.unionByName(others[0]).unionByName(others[1]), f"{scratch(spark, 'bundle')}/results"
    facts = files.select("file", F.col("file").alias("fact"))
    builder.build(files.where(n % 2 == 0), answers, facts, path, ["en", "ta"])
    builder.build(files, answers, facts, path, ["en", "ta", "hi"])
    return spark.read.schema("value string, lang string, file string").text(path).select("file", "lang", F.col("value").alias("body"))
