"""Streaming queries: run to the end of their input, their sink is returned as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.saved import SavedResults
from ..sources.shared import scratch
from ..sources.tables import table
from ..streaming import limiter
from ..streaming.store import ResultStore
from .feed_queries import rate_limits
from .registry import SQL, query


def _finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input that there is, into Parquet files."""
    place = scratch(spark)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = table(spark, sf_dir, "events")
    return spark.readStream.schema(still.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query(SQL[rate_limits.__name__])
def rate_limits_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over a stream of calls; one file is one micro-batch here, so its order is that of time."""
    events = _events(spark, sf_dir)
    calls = events.select(F.col("event_type").alias("endpoint"), F.col("user_id").alias("ip"), F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("t"), "ts")
    return _finished(spark, limiter.limit_stream(calls, 2, 86400, "ts")).select("endpoint", "ip", "id", "allowed")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(SQL[rate_limits.__name__])
def rate_limits_by_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter with list state of buckets of callers in RocksDB, cleared by timers of event time."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = _events(spark, sf_dir)
    calls = events.select(F.col("event_type").alias("endpoint"), F.col("user_id").alias("ip"), F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("t"), "ts")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return _finished(spark, limiter.limit_calls(calls, 2, 86400, "ts", buckets=limiter.BUCKETS)).select("endpoint", "ip", "id", "allowed")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query(
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS owner, CAST(event_id % 7 AS VARCHAR) AS id, event_id AS seq, event_type AS title,
  CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'upsert' WHEN 2 THEN 'upsert' ELSE 'patch' END AS op FROM events
), r AS (SELECT owner, id, max(seq) AS "at", arg_max(op, seq) AS op, arg_max(title, seq) AS title FROM c WHERE op <> 'patch' GROUP BY owner, id
), p AS (SELECT c.owner, c.id, max(seq) FILTER (seq % 2 = 0) AS even, max(seq) FILTER (seq % 2 = 1) AS odd FROM c JOIN r ON c.owner = r.owner AND c.id = r.id AND c.op = 'patch' AND c.seq > r."at" GROUP BY c.owner, c.id
), n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY "at" DESC, id DESC) AS k FROM r WHERE op = 'upsert')
SELECT n.owner, n.id, n."at", n.title, coalesce('p' || p.even, 'u' || n."at") AS even, 'p' || p.odd AS odd FROM n LEFT JOIN p ON p.owner = n.owner AND p.id = n.id WHERE k <= 4"""
)
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of upserts, patches and deletes into a store that keeps the four newest results of each owner."""
    k = F.col("event_id")
    op = F.when(k % 5 == 0, "delete").when((k % 5).isin(1, 2), "upsert").otherwise("patch")
    name = lambda sign: F.concat(F.lit(sign), k.cast("string"))
    fields = F.when(op == "upsert", F.create_map(F.lit("even"), name("u"))).otherwise(F.create_map(F.when(k % 2 == 0, "even").otherwise("odd"), name("p")))
    changes = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("owner"), (k % 7).cast("string").alias("id"), k.alias("seq"), op.alias("op"), F.col("event_type").alias("title"), fields.alias("fields"))
    place = scratch(spark, "store")
    store = ResultStore(spark, f"{place}/results", keep=4, buckets=8)
    store.sink(changes, f"{place}/state")().awaitTermination()
    return store.read().select("owner", "id", "at", "title", F.col("fields")["even"].alias("even"), F.col("fields")["odd"].alias("odd"))


@query(
    """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS owner, CAST(event_id AS VARCHAR) AS id, event_id AS "at", event_type AS title, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT owner, id, n."at", title, 'newest' AS read_as FROM n WHERE k <= 3 UNION ALL SELECT owner, id, n."at", title, 'one owner' FROM n WHERE owner = '7' AND k <= 20"""
)
def newest_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest results of each owner, and all of one owner, through the data source of the store."""
    changes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.lit("upsert").alias("op"), F.col("event_type").alias("title"), F.create_map().cast("map<string,string>").alias("fields"))
    place = scratch(spark, "saved")
    ResultStore(spark, place, keep=20, buckets=8).apply(changes, 0)
    spark.dataSource.register(SavedResults)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    saved = lambda **more: spark.read.format("saved_results").options(path=place, buckets=8, **more).load().select("owner", "id", "at", "title")
    return saved(newest=3).withColumn("read_as", F.lit("newest")).unionByName(saved().where("owner = '7'").withColumn("read_as", F.lit("one owner")))


@query(
    """WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM d, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY ALL"""
)
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed daily windows; those that the watermark has not passed stay open and are not written."""
    found = _finished(spark, limiter.windowed_counts(_events(spark, sf_dir)))
    return found.select(F.col("window.start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
