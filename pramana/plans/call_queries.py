"""Queries about calls to services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls
from ..sources.tables import table
from .registry import query


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN true WHEN event_id % 6 = 0 THEN true WHEN event_id % 6 = 1 THEN false ELSE event_id % 7 = 1 OR event_id % 5 IN (0, 1) END AS again,
  event_id % 2 = 0 AND event_id % 6 IN (3, 4) AS read_again FROM events"""
)
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 500 END AS code",
        "CASE event_id % 7 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ServiceUnavailable' ELSE 'ValueError' END AS kind",
        "CASE event_id % 5 WHEN 0 THEN 'The request Timed Out' WHEN 1 THEN 'DEADLINE exceeded' WHEN 2 THEN 'bad value' WHEN 3 THEN '' END AS message",
        "CASE event_id % 6 WHEN 3 THEN 0 WHEN 4 THEN 502 WHEN 5 THEN 504 END AS status",
        "event_id % 2 AS attempt",
    )
    return rows.select("event_id", calls.may_repeat(F.col("code"), F.col("kind"), F.col("message")).alias("again"), calls.may_read_again(F.col("status"), F.col("attempt")).alias("read_again"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'b' WHEN 2 THEN 'a' WHEN 4 THEN 'a' END AS voice FROM customer")
def chosen_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 6 WHEN 0 THEN 'ta' WHEN 1 THEN 'en' WHEN 2 THEN 'HI' WHEN 3 THEN 'or' WHEN 4 THEN 'fr_FR' END AS lang",
        "CASE c_custkey % 6 WHEN 0 THEN array(struct('a' AS name, 'ta' AS lang), struct('b' AS name, 'ta_IN' AS lang)) WHEN 1 THEN array(struct('a' AS name, 'en-US' AS lang), struct('b' AS name, 'en-GB' AS lang)) "
        "WHEN 2 THEN array(struct('c' AS name, 'ta' AS lang), struct('a' AS name, 'hi-Latn' AS lang)) WHEN 3 THEN array(struct('a' AS name, 'en' AS lang)) ELSE array(struct('a' AS name, 'FR-fr' AS lang), struct('b' AS name, 'fr_FR' AS lang)) END AS voices",
    )
    return rows.select("c_custkey", calls.best_voice(F.col("voices"), F.col("lang"))["name"].alias("voice"))
