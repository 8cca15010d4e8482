"""Queries of the date and deadline functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..sources.tables import DATE_TEXT, DAY, LETTER, MONTH, SPAN_TEXT, YEAR, table
from .registry import query

TODAY = "1997-06-15"
_PARSED = f"""CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN CAST({YEAR} || '-10-' || {DAY} AS DATE) WHEN 3 THEN CAST({YEAR} || '-10-' || {DAY} AS DATE) ELSE CAST(o_orderdate AS DATE) END"""


def _day(text: str = TODAY):
    return F.to_date(F.lit(text))


@query(f"SELECT o_orderkey, CAST({_PARSED} AS VARCHAR) AS parsed FROM orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{DATE_TEXT} AS t").select("o_orderkey", D.parse_date(F.col("t")).cast("string").alias("parsed"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'recurring' WHEN o_orderkey % 7 = 0 THEN 'calculated' WHEN d IS NULL THEN 'none' WHEN d < DATE '{TODAY}' THEN 'passed' ELSE 'upcoming' END AS status
FROM (SELECT o_orderkey, {_PARSED} AS d FROM orders)"""
)
def date_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{DATE_TEXT} AS t", "o_orderkey % 7 = 0 AS c", "o_orderkey % 10 = 0 AS r")
    return rows.select("o_orderkey", D.status(F.col("t"), F.col("c"), F.col("r"), _day()).alias("status"))


@query(
    f"""WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, o_orderkey % 6 AS k, o_custkey AS c FROM orders),
d AS (SELECT o_orderkey, a, CASE k WHEN 0 THEN a + CAST(ceil((c % 90) / 24.0) AS INTEGER) WHEN 1 THEN a + CAST(c % 40 AS INTEGER) WHEN 2 THEN a + 14 WHEN 3 THEN CAST(a + to_months(CAST(c % 14 AS INTEGER)) AS DATE) END AS due FROM s)
SELECT o_orderkey, CASE WHEN due > a THEN CAST(due AS VARCHAR) END AS due, CASE WHEN due > a THEN CAST(due - a AS INTEGER) END AS days, CASE WHEN due > a THEN due < DATE '{TODAY}' END AS past FROM d"""
)
def relative_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS anchor", f"{SPAN_TEXT} AS t")
    found = rows.select("o_orderkey", D.due_date(F.col("anchor"), D.english_span(F.col("t"))).alias("d"))
    return found.select("o_orderkey", F.col("d.due").cast("string").alias("due"), F.col("d.days").alias("days"), (F.col("d.due") < _day()).alias("past"))


_TWO = f"{LETTER} || CASE WHEN o_orderkey % 3 = 0 THEN ' Last date for payment: 25.' || {MONTH} || '.' || {YEAR} ELSE '' END || ' ' || repeat('x ', 40) || ' sent 1.2.1999'"


@query(
    f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST({YEAR} || '-' || {MONTH} || '-25' AS DATE) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND a <> b THEN strftime(least(a, b), '%-d %b %Y') || ' and ' || strftime(greatest(a, b), '%-d %b %Y') END AS conflict FROM d"""
)
def payment_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_TWO} AS t").select("o_orderkey", D.payment_conflict(F.col("t")).alias("conflict"))


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS e, CAST(o_custkey % 4 AS INTEGER) AS m, CAST(o_custkey % 3 * 15 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN m > 0 THEN CAST(date_trunc('month', e) - to_months(m) AS DATE) + CAST(day(e) AS INTEGER) - 1 WHEN n > 0 THEN e - n END AS VARCHAR) AS notice FROM d"""
)
def notice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.notice_by(F.to_date("o_orderdate"), (F.col("o_custkey") % 4).cast("int"), (F.col("o_custkey") % 3 * 15).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.cast("string").alias("notice"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 40 BETWEEN 1 AND 31 AND o_orderkey % 2 = 0 THEN 'FREQ=MONTHLY;BYMONTHDAY=' || CAST(o_custkey % 40 AS VARCHAR) END AS rule FROM orders")
def instalment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenure = F.when(F.col("o_orderkey") % 2 == 0, "12 months").otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.instalment_rule(F.col("o_custkey") % 40, tenure).alias("rule"))


@query(f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '{TODAY}' AS INTEGER) AS days, strftime(o_orderdate, '%-d %b %Y') AS human FROM orders")
def days_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(day, _day()).alias("days"), D.human_date(day).alias("human"))


@query(
    f"""SELECT o_orderkey, CASE WHEN date_trunc('week', d) = date_trunc('week', DATE '{TODAY}') THEN 'this_week' WHEN date_trunc('month', d) = date_trunc('month', DATE '{TODAY}') THEN 'this_month' ELSE strftime(d, '%Y-%m') END AS label
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def library_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.library_label(F.to_date("o_orderdate"), _day()).alias("label"))


@query(
    f"""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, o_orderkey % 6 AS k, o_custkey AS c, {_PARSED} AS printed, o_orderkey % 9 = 0 AS r FROM orders),
d AS (SELECT *, CASE k WHEN 0 THEN a + CAST(ceil((c % 90) / 24.0) AS INTEGER) WHEN 1 THEN a + CAST(c % 40 AS INTEGER) WHEN 2 THEN a + 14 WHEN 3 THEN CAST(a + to_months(CAST(c % 14 AS INTEGER)) AS DATE) END AS due FROM p)
SELECT o_orderkey, CASE WHEN r THEN NULL WHEN due > a THEN CAST(due AS VARCHAR) ELSE CAST(printed AS VARCHAR) END AS due,
  CASE WHEN r THEN 'recurring' WHEN due > a THEN 'calculated' WHEN printed IS NULL THEN 'none' WHEN printed < DATE '{TODAY}' THEN 'passed' ELSE 'upcoming' END AS status FROM d"""
)
def action_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring actions first, then deadlines counted from the letter, then printed dates."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS anchor", f"{SPAN_TEXT} AS t", f"{DATE_TEXT} AS printed", "o_orderkey % 9 = 0 AS r")
    rows = rows.withColumn("d", D.due_date(F.col("anchor"), D.english_span(F.col("t"))))
    due = F.when(~F.col("r"), F.coalesce(F.col("d.due"), D.parse_date(F.col("printed"))))
    return rows.select("o_orderkey", due.cast("string").alias("due"), D.status(F.col("printed"), F.col("d").isNotNull(), F.col("r"), _day()).alias("status"))
