"""Bundled results, built once each: one work item for every file and language, resumed by what is there.

The English result of a file comes first; a translation is built from the turn in
which the English one is there. What a model has answered is a table. An answer that
lacks a fact which its file must state, or that is no object with a title, is
rejected and not written. A language is one job: its results appear together when
it commits, each as one file in a folder of its own, and a run that is stopped and
started again builds only what is missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "en"


def built(spark: SparkSession, path: str) -> DataFrame:
    """(file, lang) of the results that are there: from the names of folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "file string, lang string")
    return spark.read.schema("value string, lang string, file string").text(path).select("file", "lang").distinct()


def checked(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers (file, lang, body) with `missing`: the facts (file, fact) that a body does not hold, in order; null for a body that is no object with a title."""
    of_file = facts.groupBy("file").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    joined = answers.join(of_file, "file", "left")
    missing = F.filter(F.coalesce("facts", F.array().cast("array<string>")), lambda f: ~F.contains("body", f))
    good = F.coalesce(F.trim("body").startswith("{") & (F.get_json_object("body", "$.title") != ""), F.lit(False))
    return joined.select("file", "lang", "body", F.when(good, missing).alias("missing"))


def build(files: DataFrame, answers: DataFrame, facts: DataFrame, path: str, languages: Iterable[str]) -> dict[str, int]:
    """Writes the results that are missing, language by language; how many were written for each.

    files: (file). Of several answers for one item the least by text is taken. Facts are asked of the English result only:
    translations state them in other words.
    """
    spark, done = files.sparkSession, {}
    for lang in [FIRST, *(x for x in languages if x != FIRST)]:
        there = built(spark, path)
        wanted = files.select("file").distinct().join(there.where(F.col("lang") == lang).select("file"), "file", "left_anti")
        if lang != FIRST:
            wanted = wanted.join(there.where(F.col("lang") == FIRST).select("file"), "file", "left_semi")
        mine = answers.where(F.col("lang") == lang).join(wanted, "file", "left_semi")
        asked = facts if lang == FIRST else facts.limit(0)
        good = checked(mine, asked).where("size(missing) = 0").groupBy("file").agg(F.min("body").alias("value"))
        rows = good.select("value", F.lit(lang).alias("lang"), "file")
        n = rows.count()
        if n:
            rows.repartition("file").write.mode("append").partitionBy("lang", "file").text(path)
        done[lang] = n
    return done
