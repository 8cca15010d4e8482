"""Queries of the text, number and masking functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import AMOUNT_TEXT, GROUPED, LETTER, TITLE, WHOLE, table
from .registry import query

# An address begins where a run of its characters does, or where the last one ended: so a long run is not tried from each of its characters.
_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G){_ADDRESS}"
PHONE, LONG_NUMBER = r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\d{16}"


@query(
    f"""SELECT lang, count(*) AS docs,
  CAST(sum(len(regexp_extract_all(text, '{_ADDRESS}'))) AS BIGINT) AS emails,
  CAST(sum(len(regexp_extract_all(text, '{PHONE.replace(chr(92), chr(92))}'))) AS BIGINT) AS phones,
  CAST(sum(len(regexp_extract_all(text, '{LONG_NUMBER}'))) AS BIGINT) AS long_numbers,
  CAST(sum(length(regexp_replace(regexp_replace(text, '{_ADDRESS}', '*', 'g'), '{LONG_NUMBER}', '**', 'g'))) AS BIGINT) AS masked_chars
FROM documents GROUP BY lang"""
)
def contact_spans_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal spans found and masked, by language: one scan, one small aggregate."""
    t = F.col("text")
    masked = F.regexp_replace(F.regexp_replace(t, EMAIL, "*"), LONG_NUMBER, "**")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.regexp_count(t, F.lit(EMAIL))).alias("emails"),
        F.sum(F.regexp_count(t, F.lit(PHONE))).alias("phones"),
        F.sum(F.regexp_count(t, F.lit(LONG_NUMBER))).alias("long_numbers"),
        F.sum(F.length(masked)).alias("masked_chars"),
    )


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("collapsed"))


@query(f"SELECT o_orderkey, translate({AMOUNT_TEXT}, '०१२३४५६७८९', '0123456789') AS folded FROM orders")
def fold_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{AMOUNT_TEXT} AS t").select("o_orderkey", T.fold_evidence_digits(F.col("t")).alias("folded"))


_FOLDED = "translate(t, '०१२३४५६७८९௦௧௨௩௪௫௬௭௮௯', '01234567890123456789')"
_BARE = rf"regexp_replace(regexp_replace({_FOLDED}, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"
_GUARD = rf"regexp_replace(regexp_replace({_BARE}, '(Rs\.?|INR) ', '₹ ', 'g'), '₹ ', '₹ ', 'g')"


@query(f"SELECT o_orderkey, {_GUARD} AS form FROM (SELECT o_orderkey, {LETTER} AS t FROM orders)")
def guard_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS t").select("o_orderkey", T.guard_form(F.col("t")).alias("form"))


EVIDENCE = rf"lower(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({_GUARD}, '₹ +', '₹', 'g'), '(\d)\.00', '\1', 'g'), '(\d)/(\d)', '\1-\2', 'g'), 'lacs', 'lakh'), '\s+', ' ', 'g'))"


@query(f"SELECT o_orderkey, {EVIDENCE} AS form FROM (SELECT o_orderkey, {LETTER} AS t FROM orders)")
def evidence_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS t").select("o_orderkey", T.evidence_form(F.col("t")).alias("form"))


@query(
    rf"""SELECT o_orderkey, array_to_string(list_transform(list_concat(list_concat(
  regexp_extract_all(t, '(?:Rs\.?|₹|INR)\s*[0-9०-९,]+(?:\.[0-9]+)?'),
  regexp_extract_all(t, '\b[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}\b')),
  regexp_extract_all(t, '1800[\s-]?[0-9]{{3}}[\s-]?[0-9]{{3,4}}')), lambda x: trim(x)), '|') AS tokens
FROM (SELECT o_orderkey, {LETTER} AS t FROM orders)"""
)
def critical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS t").select("o_orderkey", F.array_join(T.critical_tokens(F.col("t")), "|").alias("tokens"))


@query(rf"SELECT o_orderkey, array_to_string(regexp_extract_all({_BARE}, '\b\d+(?:\.\d+)?\b'), '|') AS numbers FROM (SELECT o_orderkey, {LETTER} AS t FROM orders)")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS t").select("o_orderkey", F.array_join(T.numbers(F.col("t")), "|").alias("numbers"))


@query(rf"SELECT o_orderkey, array_to_string(regexp_extract_all({_BARE}, '\d+'), '|') AS runs FROM (SELECT o_orderkey, {LETTER} AS t FROM orders)")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS t").select("o_orderkey", F.array_join(T.digit_runs(F.col("t")), "|").alias("runs"))


_TERMS = "CASE p_partkey % 5 WHEN 0 THEN 'Claims Department' WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN 'Cell 4' WHEN 3 THEN '' ELSE 'Office of the Board' END"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN trim(p_name) WHEN 2 THEN 'Cell 4' ELSE '' END AS kept FROM part")
def protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").selectExpr("p_partkey", f"array({_TERMS}) AS terms")
    return terms.select("p_partkey", F.array_join(T.protected_terms(F.col("terms")), "|").alias("kept"))


_MIXED = "CASE o_orderkey % 3 WHEN 0 THEN 'பணம் செலுத்து by mail' WHEN 1 THEN 'Pay the bill' ELSE '123' END || o_orderpriority"


@query(
    f"""SELECT o_orderkey, round(CASE WHEN len(l) = 0 THEN 1.0 ELSE len(own) / len(l) END, 6) AS share, CASE WHEN len(l) = 0 THEN true ELSE len(own) / len(l) >= 0.4 END AS passes
FROM (SELECT o_orderkey, regexp_extract_all(t, '\\p{{L}}') AS l, list_filter(regexp_extract_all(t, '\\p{{L}}'), lambda x: unicode(x) BETWEEN 2944 AND 3071) AS own FROM (SELECT o_orderkey, {_MIXED} AS t FROM orders))"""
)
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = T.script_share(F.col("t"), "ta")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MIXED} AS t").select("o_orderkey", F.round(share, 6).alias("share"), (share >= 0.4).alias("passes"))


@query(f"SELECT p_partkey, CASE p_partkey % 12 WHEN 8 THEN 'Monthly Rent Notice' ELSE {TITLE} END AS heading FROM part")
def title_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{TITLE} AS t").select("p_partkey", T.title_heading(F.col("t")).alias("heading"))


@query(
    """WITH n AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) * 37 AS VARCHAR) AS s FROM orders),
h AS (SELECT o_orderkey, s, CASE WHEN length(s) > 3 THEN substr(s, 1, length(s) - 3) ELSE '' END AS head FROM n)
SELECT o_orderkey, CASE WHEN head = '' THEN s ELSE reverse(rtrim(regexp_replace(reverse(head), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || right(s, 3) END AS grouped FROM h"""
)
def indian_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.floor("o_totalprice") * 37).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.indian_grouping(n).alias("grouped"))


@query("SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '…' END AS short FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents)")
def reminder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"))


@query(
    """SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(p_name, i, 1)) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)))), 8, '0') AS hash FROM part"""
)
def rolling_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.rolling_hash(F.col("p_name")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


_FORWARDED = "CASE c_custkey % 4 WHEN 0 THEN '10.0.0.1, 10.0.' || CAST(c_custkey % 250 AS STRING) || '.7' WHEN 1 THEN ' , ' WHEN 2 THEN NULL ELSE '9.9.9.9, ' END"
_PEER = "CASE WHEN c_custkey % 8 = 1 THEN NULL WHEN c_custkey % 8 = 2 THEN '' ELSE '192.168.0.' || CAST(c_custkey % 200 AS STRING) END"


@query(
    f"""SELECT c_custkey, coalesce(list_filter(list_transform(string_split(coalesce({_FORWARDED}, ''), ','), lambda x: trim(x)), lambda x: x <> '')[-1], nullif({_PEER}, ''), 'unknown') AS address FROM customer"""
)
def client_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_FORWARDED} AS f", f"{_PEER} AS p")
    return calls.select("c_custkey", T.client_address(F.col("f"), F.col("p")).alias("address"))


_PHONE_TEXT = "CASE c_custkey % 4 WHEN 0 THEN ' +91 80 4000 ' || CAST(c_custkey AS STRING) WHEN 1 THEN '12-34' WHEN 2 THEN '௧௮௦௦ 200 3000' ELSE '1234567890123456' END"


@query(rf"SELECT c_custkey, CASE WHEN length(regexp_replace(translate(t, '௦௧௨௩௪௫௬௭௮௯', '0123456789'), '[^0-9]', '', 'g')) BETWEEN 7 AND 13 THEN trim(t) END AS phone FROM (SELECT c_custkey, {_PHONE_TEXT} AS t FROM customer)")
def valid_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PHONE_TEXT} AS t").select("c_custkey", T.phone_digits(F.col("t")).alias("phone"))


_VALUE = f"CASE o_orderkey % 5 WHEN 0 THEN 'Rs. ' || {GROUPED} WHEN 1 THEN {WHOLE} WHEN 2 THEN 'CLM ' || {WHOLE} WHEN 3 THEN '1,2,3,4' ELSE '₹0' END"
_VALUE_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'text' ELSE 'date' END"


@query(
    f"""SELECT o_orderkey, k <> 'date' AND (k = 'amount' OR regexp_matches(v, '[₹]|Rs\\.?|INR')) AND NOT regexp_matches(regexp_replace(v, 'Rs\\.?|INR', '', 'g'), '[A-Za-z]')
  AND length(v) - length(replace(v, ',', '')) <= 2 AND coalesce(try_cast(regexp_replace(v, '[^0-9.]', '', 'g') AS DOUBLE) > 0, false) AS money
FROM (SELECT o_orderkey, {_VALUE} AS v, {_VALUE_KIND} AS k FROM orders)"""
)
def money_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_VALUE} AS v", f"{_VALUE_KIND} AS k").select("o_orderkey", T.money_value(F.col("k"), F.col("v")).alias("money"))


_ID = "CASE o_orderkey % 3 WHEN 0 THEN 'CD-2026-' || CAST(o_orderkey + 10000 AS STRING) WHEN 1 THEN 'ABCDE' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || 'F' ELSE CAST(o_orderkey + 1000000 AS STRING) || '/89' END"


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 3
  WHEN 0 THEN 'CD-****-' || repeat('*', length(i) - 11) || right(i, 3)
  WHEN 1 THEN '*******' || right(i, 3)
  ELSE repeat('*', length(i) - 4) || right(i, 4) END AS masked
FROM (SELECT o_orderkey, {_ID} AS i FROM orders)"""
)
def mask_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ID} AS i").select("o_orderkey", T.mask_id(F.col("i")).alias("masked"))


@query(
    f"""SELECT doc_id, e AS email, substr(e, 1, 1) || '***@****.' || regexp_extract(e, '([^.]*)$', 1) AS masked
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_ADDRESS}')) AS e FROM documents)"""
)
def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))).alias("email"))
    return found.select("doc_id", "email", T.mask_email(F.col("email")).alias("masked")).distinct()
