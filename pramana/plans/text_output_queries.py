"""Queries of masking, speech and output functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sinks, speech
from ..operators import masking
from ..sources.tables import table
from .registry import query


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*\.([A-Za-z]{2,})', '\1***@****.\2', 'g'), '(?:\+\d{1,2}[\s-]?)?(?:\(\d{3}\)|\d{3,5})[\s-]\d{3}[\s-]\d{4}', '**********', 'g'), '\b\d{13}(\d{3})\b', '*************\1', 'g')) AS masked
FROM documents"""
)
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with all spans masked."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masking.masked(F.col("text"))).alias("masked"))


@query()
def masked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted span of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(masking.spans(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.start", F.length("s.text").alias("length"), "s.kind", masking.mask(F.col("s.kind"), F.col("s.text")).alias("mask"))


_SAY = "'Dr. ' || p_name || ' paid Rs. ' || CAST(p_size AS STRING) || '.50 today. See e.g. page ' || CAST(p_partkey AS STRING) || '. Done! ' || p_type"


@query(f"SELECT p_partkey, 'Dr. ' || p_name || ' paid Rs. ' || CAST(p_size AS VARCHAR) || '.50 today.|See e.g. page ' || CAST(p_partkey AS VARCHAR) || '.|Done!|' || p_type AS sentences FROM part")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SAY} AS t").select("p_partkey", F.array_join(speech.sentences(F.col("t")), "|").alias("sentences"))


@query(
    """SELECT p_partkey, CASE WHEN length(a) > 60 THEN '' WHEN length(a) + 1 + length(b) > 60 THEN a WHEN length(a) + length(b) + 7 > 60 THEN a || ' ' || b WHEN length(a) + length(b) + 8 + length(p_type) > 60 THEN a || ' ' || b || ' Done!' ELSE a || ' ' || b || ' Done! ' || p_type END AS spoken
FROM (SELECT p_partkey, p_type, 'Dr. ' || p_name || ' paid Rs. ' || CAST(p_size AS VARCHAR) || '.50 today.' AS a, 'See e.g. page ' || CAST(p_partkey AS VARCHAR) || '.' AS b FROM part)"""
)
def sentences_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SAY} AS t").select("p_partkey", speech.up_to(speech.sentences(F.col("t")), 60).alias("spoken"))


@query(
    r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, conv_id, turn, list_filter(string_split_regex(text, '[\s\x0B]+'), lambda x: x <> '') AS words FROM conversations WHERE text IS NOT NULL),
r(id, i, chunk, used) AS (SELECT id, 1, 0, length(words[1]) FROM w WHERE len(words) > 0
  UNION ALL SELECT r.id, i + 1, CASE WHEN used + 1 + length(words[i + 1]) <= 180 THEN chunk ELSE chunk + 1 END, CASE WHEN used + 1 + length(words[i + 1]) <= 180 THEN used + 1 + length(words[i + 1]) ELSE length(words[i + 1]) END FROM r JOIN w ON w.id = r.id WHERE i < len(words))
SELECT conv_id, turn, CAST(chunk AS INTEGER) AS chunk, CAST(max(used) AS INTEGER) AS length FROM r JOIN w ON w.id = r.id GROUP BY r.id, conv_id, turn, chunk"""
)
def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns in chunks of at most 180 characters."""
    found = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(speech.chunks(F.col("text"))).alias("chunk", "part"))
    return found.select("conv_id", "turn", "chunk", F.length("part").alias("length"))


@query(
    r"""SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || CAST(o_orderkey AS VARCHAR) || chr(13) || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') ELSE 'DTSTART:' || strftime(o_orderdate, '%Y%m%d') || 'T090000' END || chr(13) || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN 'RRULE:FREQ=DAILY;COUNT=5' || chr(13) || chr(10) ELSE '' END || 'SUMMARY:Pay\; ' || o_orderpriority || '\, soon' || chr(13) || chr(10) || 'END:VEVENT' AS entry FROM orders"""
)
def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    entry = sinks.calendar_entry(k.cast("string"), F.to_date("o_orderdate"), F.when(k % 2 == 1, "09:00"), F.concat(F.lit("Pay; "), "o_orderpriority", F.lit(", soon")), F.when(k % 3 == 0, "FREQ=DAILY;COUNT=5"))
    return table(spark, sf_dir, "orders").select("o_orderkey", entry.alias("entry"))


@query("SELECT p_partkey, 'https://maps.example.org/?q=' || replace(p_name || ' & co', ' ', '%20') AS x FROM part WHERE false UNION ALL SELECT p_partkey, 'https://maps.example.org/?q=' || replace(replace(p_name, ' ', '%20'), ',', '%2C') || '%20%26%20co' FROM part")
def map_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sinks.search_link("https://maps.example.org/?q=", F.concat("p_name", F.lit(" & co"))).alias("x"))
