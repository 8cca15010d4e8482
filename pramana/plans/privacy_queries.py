"""Queries of personal fields, names, terms and leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masking, privacy
from ..operators.terms import occurrences
from ..sources.shared import bounded_batches
from ..sources.tables import spread, table
from .registry import query
from .text_queries import EMAIL

_FIELD = (
    "CASE o_orderkey % 10 WHEN 0 THEN 'Patient ' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'Monthly pension amount: Rs. 900' WHEN 2 THEN 'Policy number 12' WHEN 3 THEN 'Due 2026-10-01' WHEN 4 THEN 'Code AB/1234/x' WHEN 5 THEN 'Call 98765432' "
    "WHEN 6 THEN 'Shri Rao came' WHEN 7 THEN 'खाता देखें' WHEN 8 THEN 'plain words' ELSE '' END"
)


@query("SELECT o_orderkey, o_orderkey % 10 IN (0, 2, 4, 5, 6, 7) AS personal FROM orders")
def personal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_FIELD} AS t").select("o_orderkey", privacy.personal_field(F.col("t"), F.lit(None).cast("string")).alias("personal"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_name || '|' || upper(p_name) ELSE p_name || '|' || upper(p_name) END AS terms FROM part")
def expanded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "array(p_brand, p_name, p_name, ' ') AS t", "map('a', array(upper(p_name), p_name)) AS m", "CASE WHEN p_partkey % 2 = 1 THEN array(p_brand) ELSE array('none') END AS i")
    return rows.select("p_partkey", F.array_join(privacy.expanded_terms(F.col("t"), F.col("m"), F.col("i")), "|").alias("terms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || '|Rs. ' || CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def dates_and_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: F.date_format("o_orderdate", f)
    texts = F.array(F.concat(F.lit("on "), day("dd.MM.yyyy"), F.lit(" pay Rs. "), F.col("o_custkey").cast("string")), F.concat(day("yyyy-MM-dd"), F.lit(" or "), day("dd.MM.yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(privacy.dates_and_amounts(texts), "|").alias("found"))


@query("SELECT c_custkey, 'Dear Dr. A. ' || substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) || ' and R** Kumar' AS masked FROM customer")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Dear Dr. A. "), "c_name", F.lit(" and Rao Kumar"))
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.with_names_masked(text, F.array(F.lit("Rao"), F.concat(F.lit("Dr. A. "), "c_name"))).alias("masked"))


_PHRASE = r"regexp_extract(text, '^\s*(\S+\s+\S+\s+\S+)', 1)"


@query(f"SELECT doc_id, term FROM documents, (SELECT DISTINCT {_PHRASE} AS term FROM benchmark) WHERE term <> '' AND contains(text, term)")
def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first three words of an item: one pass over the texts for all phrases."""
    phrases = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+)", 1).alias("term"))
    return occurrences(table(spark, sf_dir, "documents"), phrases).select("doc_id", "term")


# Secrets of a document by its id, and the sentence that holds them.
_SENTENCE = ["'. Call '", "planted[0]", "' or '", "planted[1]", "' of '", "planted[2]", "', case '", "planted[3]", "', date of birth: '", "planted[4]", "', born '", "planted[5]", "'. Mrs. '", "planted[6]", "', applicant: '", "planted[7]"]


def _planted(k: Column) -> Column:
    digits, day = F.lpad(k.cast("string"), 9, "7"), F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(k, F.lit(15000)).cast("int"))
    tag = F.translate(F.lpad(k.cast("string"), 9, "0"), "0123456789", "abcdefghij")
    mobile, car = F.concat(F.lit("9"), digits), F.concat(F.lit("KA 05 MN "), F.right(digits, F.lit(4)))
    spaced = F.concat(F.lit("8"), F.left(digits, F.lit(4)), F.lit(" "), F.right(digits, F.lit(5)))
    return F.array(mobile, spaced, car, F.concat(F.lit("O.S. No. "), k.cast("string"), F.lit("/2025")), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "d MMM yyyy"), F.concat(F.lit("Asha "), F.initcap(tag)), F.concat(F.lit("Ravi "), F.initcap(F.reverse(tag))))


@query(
    r"""SELECT doc_id, CAST(8 + len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) + len(regexp_extract_all(coalesce(text, ''), '\b\d{16}\b')) AS BIGINT) AS secrets, CAST(0 AS BIGINT) AS leaks FROM documents"""
)
def leaks_after_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets planted in every text, and long numbers and addresses found by other patterns: how many there are, and how many still stand in the masked text (none may)."""
    docs = spread(bounded_batches(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").withColumn("planted", _planted(F.col("doc_id")))
    text = F.concat_ws(" ", "text", F.expr(f"concat({', '.join(_SENTENCE)})"))
    secrets = F.concat("planted", *(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0)) for p in (EMAIL, r"\b\d{16}\b")))
    rows = docs.select("doc_id", secrets.alias("secrets"), masking.masked(text).alias("shared"))
    return rows.select("doc_id", F.size("secrets").cast("long").alias("secrets"), privacy.leaks(F.col("secrets"), F.col("shared")).cast("long").alias("leaks"))
