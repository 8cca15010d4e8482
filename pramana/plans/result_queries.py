"""Queries of deadlines in many languages, names and decisions about single results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deadlines, names
from ..operators import results
from ..sources.tables import SPAN_TEXT, table
from .registry import query

_MANY = f"CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey % 50 AS STRING) || ' घंटे के भीतर' WHEN 1 THEN 'ஏழு நாட்களுக்குள்' WHEN 2 THEN '௧௫ ദിവസത്തിനുള്ളിൽ' WHEN 3 THEN 'দশ দিনের মধ্যে' ELSE {SPAN_TEXT} END"


@query(
    """WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS l, o_orderkey % 6 AS k, o_custkey AS c FROM orders)
SELECT o_orderkey, CASE WHEN n > 0 THEN CAST(n AS INTEGER) END AS count, CASE WHEN n > 0 THEN u END AS unit FROM (SELECT o_orderkey,
  CASE l WHEN 0 THEN c % 50 WHEN 1 THEN 7 WHEN 2 THEN 15 WHEN 3 THEN 10 ELSE CASE k WHEN 0 THEN c % 90 WHEN 1 THEN c % 40 WHEN 2 THEN 2 WHEN 3 THEN c % 14 ELSE 0 END END AS n,
  CASE l WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'day' WHEN 3 THEN 'day' ELSE CASE k WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' ELSE 'month' END END AS u FROM s)"""
)
def deadline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MANY} AS t").withColumn("s", deadlines.span(F.col("t")))
    return found.select("o_orderkey", F.col("s.count").alias("count"), F.col("s.unit").alias("unit"))


@query("SELECT o_orderkey, o_orderkey % 7 > 3 AND o_orderkey % 6 = 5 AS unread FROM orders WHERE NOT (o_custkey % 50 = 0 OR o_custkey % 90 = 0 OR o_custkey % 40 = 0 OR o_custkey % 14 = 0) UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 50 = 0 WHEN o_orderkey % 7 <= 3 THEN false ELSE CASE o_orderkey % 6 WHEN 0 THEN o_custkey % 90 = 0 WHEN 1 THEN o_custkey % 40 = 0 WHEN 3 THEN o_custkey % 14 = 0 WHEN 5 THEN true ELSE false END END FROM orders WHERE o_custkey % 50 = 0 OR o_custkey % 90 = 0 OR o_custkey % 40 = 0 OR o_custkey % 14 = 0")
def unread_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MANY} AS t").select("o_orderkey", deadlines.unread(F.col("t")).alias("unread"))


_NAMED = "CASE c_custkey % 4 WHEN 0 THEN 'Seen by Dr. Asha Rao K on Monday' WHEN 1 THEN 'Patient Name: Mr Ravi Nair and Smt. Meena' WHEN 2 THEN 'श्री रवि कुमार ने' ELSE 'Dr. Prescription, no name' END"


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Asha Rao K' WHEN 1 THEN 'Ravi Nair|Meena' WHEN 2 THEN 'रवि कुमार ने' ELSE '' END AS titled FROM customer")
def titled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NAMED} AS t").select("c_custkey", F.array_join(names.after_titles(F.col("t")), "|").alias("titled"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'Ravi Nair and' ELSE '' END AS labelled FROM customer")
def labelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NAMED.replace('no name', 'none')} AS t").select("c_custkey", F.array_join(names.after_labels(F.col("t")), "|").alias("labelled"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS missing FROM customer")
def missing_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "map(c_name, array(upper(c_name))) AS m", "CASE c_custkey % 3 WHEN 0 THEN 'nobody' WHEN 1 THEN 'to ' || c_name ELSE upper(c_name) END AS t")
    return rows.select("c_custkey", F.array_join(names.rendered_missing(F.col("m"), F.col("t")), "|").alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ':person|' || p_type || ':id' ELSE p_name || ':person' END AS kept FROM part")
def verbatim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "array(struct(p_name AS text, 'person' AS type), struct(p_name AS text, 'person' AS type), struct('x' AS text, 'id' AS type), struct(p_name AS text, 'planet' AS type), struct(p_type AS text, 'id' AS type), struct('  ' AS text, 'dob' AS type)) AS spans",
        "CASE WHEN p_partkey % 2 = 0 THEN 'x   ' || p_name || ' is ' || p_type ELSE p_name END AS source",
    )
    kept = F.transform(results.verbatim_spans(F.col("spans"), F.col("source")), lambda s: F.concat_ws(":", s["text"], s["type"]))
    return rows.select("p_partkey", F.array_join(kept, "|").alias("kept"))


_AMOUNTS = "CASE o_orderkey % 5 WHEN 0 THEN array(100.0D, 60.0D, 40.0D) WHEN 1 THEN array(100.0D, 60.0D, 30.0D) WHEN 2 THEN array(5.0D) WHEN 3 THEN CAST(array() AS array<double>) ELSE array(1.0D, 2.0D, 9.0D, 4.0D) END"


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'multi' WHEN o_custkey % 7 = 0 THEN 'Dplus' WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'F' END WHEN o_orderkey % 5 = 1 THEN 'F' WHEN o_orderkey % 5 = 2 THEN 'B'
  WHEN o_orderkey % 5 = 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'C' WHEN o_custkey % 6 BETWEEN 1 AND 4 THEN 'D' ELSE 'E' END ELSE 'E' END AS glance FROM orders"""
)
def glance_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 0 END AS parts", "CASE WHEN o_custkey % 7 = 0 THEN 3 ELSE 0 END AS labs", f"{_AMOUNTS} AS a", "CASE WHEN o_orderkey % 2 = 0 THEN 'insurance' ELSE 'form' END AS kind", "o_orderkey % 3 = 0 AS up", "o_custkey % 6 AS texts")
    return rows.select("o_orderkey", results.glance(F.col("parts"), F.col("labs"), F.col("a"), F.col("kind"), F.col("up"), F.col("texts")).alias("glance"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 50 * 100 + 0.5) AS INTEGER) AS approved, 100 - CAST(floor(l_quantity / 50 * 100 + 0.5) AS INTEGER) AS rest FROM lineitem")
def split_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").withColumn("s", results.split_shares(F.col("l_quantity"), F.lit(50.0)))
    return found.select("l_orderkey", "l_linenumber", "s.approved", "s.rest")


@query(
    """SELECT event_id, CASE WHEN t >= 1 THEN 'writing' WHEN t < 0.35 THEN 'reading' WHEN t < 0.7 THEN 'checking' ELSE 'writing' END AS stage,
  round(CASE WHEN t >= 1 THEN 95.0 WHEN t < 0.35 THEN 35 * (1 - (1 - t / 0.35) ** 2) WHEN t < 0.7 THEN 35 + 35 * (1 - (1 - (t - 0.35) / 0.35) ** 2) ELSE 70 + 25 * (1 - (1 - (t - 0.7) / 0.3) ** 2) END, 6) AS percent
FROM (SELECT event_id, CAST(event_id % 60 AS DOUBLE) / CASE WHEN user_id % 2 = 0 THEN 9 * greatest(user_id % 5, 1) ELSE 8 + 6 * greatest(user_id % 7, 1) END AS t FROM events)"""
)
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = F.when(F.col("user_id") % 2 == 0, F.greatest(F.col("user_id") % 5, F.lit(1))).otherwise(0)
    found = results.progress((F.col("event_id") % 60).cast("double"), results.expected_seconds(photos, F.col("user_id") % 7).cast("double"))
    return table(spark, sf_dir, "events").withColumn("p", found).select("event_id", "p.stage", "p.percent")


@query(
    """SELECT o_orderkey, substr(array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Bill' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'City Power Board of the North' [1:28] END, strftime(o_orderdate, '%-d %b')], lambda x: x <> ''), ' · '), 1, 60) AS name FROM orders"""
)
def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind, issuer = F.when(k % 3 == 0, " ").otherwise("Bill"), F.when(k % 4 == 0, "Dr. Rao, Clinic").otherwise("City  Power Board of the North, Ward 4")
    return table(spark, sf_dir, "orders").select("o_orderkey", results.default_name(kind, issuer, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'calculated' WHEN 1 THEN 'matched' ELSE CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'check_original' END END AS chip FROM orders")
def action_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 4 == 0, "calculated").when(k % 4 == 1, "matched").otherwise("check_original")
    return table(spark, sf_dir, "orders").select("o_orderkey", results.action_chip(label, F.when(k % 5 > 0, "words"), k % 3 == 0).alias("chip"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 5 AND l_suppkey % 4 > 0 THEN l_linenumber + (l_suppkey % 4) * 5 ELSE l_linenumber END AS page FROM lineitem")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_suppkey") % 4 * 5 + 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", results.shifted_page(F.col("l_linenumber"), start, F.lit(5)).alias("page"))


@query(
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'unexpected_field' WHEN 1 THEN 'rating' WHEN 2 THEN 'lang' WHEN 3 THEN 'version' WHEN 4 THEN 'reasons_not_allowed' WHEN 5 THEN 'too_many_reasons' WHEN 6 THEN 'reason' END AS error FROM events"""
)
def feedback_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 9
    keys = F.when(k == 0, F.array(F.lit("rating"), F.lit("odd"))).otherwise(F.array(F.lit("rating"), F.lit("lang")))
    reasons = F.when(k == 4, F.array(F.lit("other"))).when(k == 5, F.array_repeat(F.lit("other"), 6)).when(k == 6, F.array(F.lit("free text"))).when(k == 7, F.array(F.lit("other")))
    rating = F.when(k == 1, F.lit(None)).when(k >= 5, "down").otherwise("up")
    error = results.feedback_error(keys, rating, F.when(k == 2, "auto").otherwise("hi"), F.when(k == 3, "v 1").otherwise("1.0"), reasons, ["other", "wrong_amount"])
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'who=Board' ELSE 'sum=' || CAST(o_orderkey AS VARCHAR) || '|who=Board' END AS facts FROM orders")
def answer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(struct('sum' AS label, CAST(o_orderkey AS STRING) AS value), struct('odd' AS label, '987654321' AS value), struct(' ' AS label, 'x' AS value), struct('who' AS label, 'Board' AS value)) AS f", "'No. 0' || CAST(o_orderkey AS STRING) || ', ' || CAST(o_orderkey AS STRING) AS t")
    kept = F.transform(results.answer_facts(F.col("f"), F.col("t"), F.col("o_orderkey") % 2 == 0), lambda x: F.concat_ws("=", x["label"], x["value"]))
    return rows.select("o_orderkey", F.array_join(kept, "|").alias("facts"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE '' END AS said FROM part")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("text")))).when(F.col("p_partkey") % 3 == 1, "not json").otherwise('{"other": 1}')
    return table(spark, sf_dir, "part").select("p_partkey", results.transcript(raw).alias("said"))


@query("SELECT p_partkey, p_size AS pages FROM part")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("%PDF-1.7 /Type /Pages "), F.repeat(F.lit("<< /Type /Page >> "), F.col("p_size"))).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", results.page_count(content).alias("pages"))


@query(
    """SELECT p_partkey, m AS medicine, s AS slot, t AS time, CAST(DATE '2026-10-08' + CASE WHEN t <= '12:30' THEN 1 ELSE 0 END AS VARCHAR) AS day FROM part, (VALUES (0, 'morning', '08:00'), (1, 'night', '20:15')) v(m, s, t) WHERE m = 0 OR p_partkey % 2 = 0"""
)
def dose_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "map('0-morning', true, '1-night', p_partkey % 2 = 0, '2-evening', false) AS slots", "map('1-night', '20:15') AS times")
    events = rows.select("p_partkey", F.inline(results.dose_events(F.col("slots"), F.col("times"))))
    return events.withColumn("day", results.next_dose(F.to_date(F.lit("2026-10-08")), F.lit(750), F.col("time")).cast("string"))
