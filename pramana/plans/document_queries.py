"""Queries of evidence, guards and decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import critical_tokens as tokens_of
from ..operators import decoders, evidence, guards
from ..sources.shared import scratch
from ..sources.tables import FREQUENCY, KIND, LAB_FLAG, LAB_RANGE, LAB_VALUE, LETTER, TITLE, TRANSLATED, spread, table
from .registry import SQL, query


#: Tasks for a partition of the lines of packets.
PACKET_PARTS = 24


def _letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (three of each customer's letters a page) and quoted items: own, cut, foreign, blank and with another amount."""
    orders = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey")  # pages and items meet by customer
    orders = orders.selectExpr("o_custkey AS doc_id", "CAST(o_orderkey % 3 + 1 AS INT) AS page", f"{LETTER} AS letter", "o_orderkey", "o_custkey")
    pages = orders.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "letter"))), lambda x: x["letter"]), "\n").alias("text"))
    items = orders.selectExpr(
        "doc_id",
        "o_orderkey AS pos",
        "CASE o_orderkey % 5 WHEN 0 THEN letter WHEN 1 THEN substr(letter, 1, 30) WHEN 2 THEN 'Please send ' || letter WHEN 3 THEN ' ' ELSE letter END AS quote",
        "CASE WHEN o_orderkey % 5 = 4 THEN 'Rs. 1' ELSE 'Pay' END AS text",
        "CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE page END AS page",
        "o_orderkey % 11 = 0 AS is_calculated",
    )
    return items, pages


@query(
    """SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 11 = 0 THEN 'calculated'
  WHEN o_orderkey % 5 IN (0, 1) THEN 'matched' WHEN o_orderkey % 5 IN (2, 3) THEN 'check_original'
  ELSE CASE WHEN position('₹1' IN d.body) > 0 THEN 'matched' ELSE 'check_original' END END AS evidence
FROM orders o JOIN (SELECT o_custkey AS c, o_orderkey % 3 + 1 AS p, string_agg(CASE WHEN o_orderkey % 4 = 3 THEN '₹' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE '₹' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END, ' ') AS body FROM orders GROUP BY ALL
  UNION ALL SELECT o_custkey, 9, string_agg('₹' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), ' ') FROM orders GROUP BY ALL) d
ON d.c = o.o_custkey AND d.p = CASE WHEN o.o_orderkey % 4 = 0 THEN 9 ELSE o.o_orderkey % 3 + 1 END"""
)
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, pages = _letters(spark, sf_dir)
    return evidence.verify(items, pages).select("doc_id", "pos", "evidence")


@query(SQL["evidence_labels"])
def indexed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a saved index: the join moves the items to the buckets of their documents, and no text."""
    items, pages = _letters(spark, sf_dir)
    path = scratch(spark, "page-index")
    index = evidence.write_index(pages, "page_index_" + path.rsplit("-", 1)[-1], path, 8)
    return evidence.verify_by(items, index).select("doc_id", "pos", "evidence")


@query(
    """SELECT o_custkey AS doc_id, CAST(count_if(e = 'matched') AS BIGINT) AS matched, CAST(count_if(e = 'calculated') AS BIGINT) AS calculated, CAST(count_if(e = 'check_original') AS BIGINT) AS check_original
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'calculated' WHEN o_orderkey % 3 = 0 THEN 'matched' ELSE 'check_original' END AS e FROM orders) GROUP BY o_custkey"""
)
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 11 == 0, "calculated").when(F.col("o_orderkey") % 3 == 0, "matched").when(F.col("o_orderkey") % 3 == 1, "odd")
    return evidence.summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), label.alias("evidence")), "doc_id")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'check_original' WHEN p_partkey % 4 = 1 AND NOT contains('12 ' || p_name, CAST(p_size AS VARCHAR)) THEN 'check_original' ELSE 'matched' END AS evidence FROM part"""
)
def lab_row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE upper(p_name) END AS label", "CAST(p_size AS STRING) AS value", "CASE WHEN p_partkey % 4 = 1 THEN '12 ' || p_name ELSE p_name || ' ' || CAST(p_size AS STRING) END AS page"
    )
    return rows.select("p_partkey", evidence.lab_row(F.col("label"), F.col("value"), F.col("page")).alias("evidence"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN 'check_original' ELSE 'matched' END AS evidence FROM customer"""
)
def contact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 3 WHEN 0 THEN '080 4000 ' || CAST(c_custkey + 1000 AS STRING) WHEN 1 THEN '080-4000-' || CAST(c_custkey + 1000 AS STRING) ELSE 'nobody' END AS value",
        "CASE WHEN c_custkey % 2 = 1 THEN 'Call 080' ELSE '' END AS quote",
        "'Call 080 4000 ' || CAST(c_custkey + 1000 AS STRING) AS page",
    )
    return rows.select("c_custkey", evidence.contact(F.col("value"), F.col("quote"), F.col("page")).alias("evidence"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS found FROM orders")
def glance_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'Rs. ' || CAST(o_orderkey + 100000 AS STRING) || ' due' AS t", "CASE WHEN o_orderkey % 2 = 0 THEN '₹' || CAST(o_orderkey + 100000 AS STRING) ELSE '₹7' || CAST(o_orderkey AS STRING) END AS v")
    return rows.select("o_orderkey", evidence.glance_amount(F.col("v"), tokens_of(F.col("t"))).alias("found"))


@query(
    """SELECT l_orderkey AS doc_id, g.page AS page, coalesce((SELECT min(p.pos) FROM (SELECT l_orderkey AS k, l_linenumber AS pos, l_linenumber * 2 AS a, CAST(l_linenumber * 2 + l_quantity % 5 AS INTEGER) - 1 AS b FROM lineitem) p
  WHERE p.k = l.l_orderkey AND g.page BETWEEN least(p.a, p.b) AND greatest(p.a, p.b)), -1) AS part
FROM (SELECT DISTINCT l_orderkey FROM lineitem) l, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS page) g"""
)
def page_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of a packet owns each page: ranges may overlap, the first one wins."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity").repartition(PACKET_PARTS * lines.rdd.getNumPartitions(), "l_orderkey")  # ranges are opened into pages: a task stays small
    parts = lines.selectExpr("l_orderkey AS doc_id", "l_linenumber AS pos", "l_linenumber * 2 AS first", "CAST(l_linenumber * 2 + l_quantity % 5 AS INT) - 1 AS last")
    pages = lines.select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return evidence.owning_part(pages, parts)


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN false WHEN 2 THEN NOT regexp_matches(n, '1') OR o_orderkey < 0 ELSE true END AS strict_kept
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || strftime(o_orderdate, '%d%m%Y') || '1800' AS n FROM orders)"""
)
def translation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers kept in translation: digits in another script pass, a changed digit or an empty text fails."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{LETTER} AS a", f"{TRANSLATED} AS b")
    return rows.select("o_orderkey", guards.translation_keeps_numbers(F.col("a"), F.col("b"), strict=True).alias("strict_kept"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS kept FROM part")
def term_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS a", "CASE WHEN p_partkey % 3 = 0 THEN 'lost' ELSE upper(p_name) || ' x' END AS b", "array(p_name, 'absent') AS terms")
    return rows.select("p_partkey", guards.translation_keeps_terms(F.col("a"), F.col("b"), F.col("terms")).alias("kept"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey + 777777 AS VARCHAR) || '|' || CAST(o_orderkey + 777777 AS VARCHAR) ELSE '' END AS missing FROM orders")
def spoken_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "'Pay ' || CAST(o_orderkey AS STRING) || ' on 05.10' AS doc", "CASE o_orderkey % 3 WHEN 0 THEN 'Pay ' || CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey + 777777 AS STRING) || ' or ' || CAST(o_orderkey + 777777 AS STRING) ELSE 'by 05.10' END AS spoken"
    )
    return rows.select("o_orderkey", F.array_join(guards.spoken_numbers_missing(F.col("spoken"), F.col("doc")), "|").alias("missing"))


@query(
    """SELECT l_orderkey AS doc_id, (min((n, kind, field)) FILTER (bad))[2] AS kind, (min((n, kind, field)) FILTER (bad))[3] AS field, CAST(count_if(bad) AS BIGINT) AS failures
FROM (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS kind, 'field_' || CAST(l_linenumber AS VARCHAR) AS field, l_quantity > 40 AS bad FROM lineitem) GROUP BY l_orderkey"""
)
def first_guard_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines share numbers in the data: ties go by kind."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS pos", "l_returnflag AS kind", "'field_' || CAST(l_linenumber AS STRING) AS field", "l_quantity <= 40 AS ok")
    return guards.first_failure(rows, "doc_id")


@query(
    """WITH k AS (SELECT p_partkey AS doc_id, 'actions_0_text' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'actions_1_text', p_type FROM part UNION ALL SELECT p_partkey, 'facts_0_text', p_brand FROM part)
SELECT doc_id, key, CASE WHEN doc_id % 3 = 0 AND key <> 'facts_0_text' THEN upper(value) ELSE value END AS value FROM k"""
)
def stitched_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts laid out by key, joined with their translations, and put back where one is missing."""
    results = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "array(p_name, p_type) AS actions", "array(p_brand) AS facts")
    keyed = guards.keyed_strings(results, ["actions", "facts"])
    translated = keyed.where("doc_id % 3 = 0").withColumn("value", F.when(F.col("key") == "facts_0_text", " ").otherwise(F.upper("value")))
    return guards.stitched(keyed, translated)


_CASES = [
    ("1-0-1", "morning,night", None, None, True), ("1-1-1", "morning,afternoon,night", "after_food", None, True), ("0-0-1", "bedtime", "at_bedtime", None, True), ("1-1-1-1", "morning,afternoon,evening,night", None, None, True),
    ("0-1-0", "afternoon", None, None, True), ("OD", "morning", None, 10, True), ("BD", "morning,night", None, 14, True), ("TDS", "morning,afternoon,night", "before_food", None, True), ("QID", "morning,afternoon,evening,night", None, None, True),
    ("HS", "bedtime", None, None, True), ("SOS", "", None, None, True), ("once a week", "", None, None, False), ("as directed", "", None, None, False), ("BD", "morning,night", None, 30, True), ("", "", None, None, False),
    ("SOS", "", "after_food", None, True), ("2-0-1", "morning,night", None, None, True), ("alternate days", "", None, None, False),
]
_quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


@query(f"SELECT p_partkey, c.code, c.slots, c.food, c.days, c.decoded FROM part JOIN (VALUES {', '.join(f'({i}, {", ".join(map(_quoted, c))})' for i, c in enumerate(_CASES))}) c(i, code, slots, food, days, decoded) ON p_partkey % 18 = c.i")
def medicine_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{FREQUENCY} AS raw").withColumn("m", decoders.medicine_frequency(F.col("raw")))
    return rows.select("p_partkey", "m.code", F.array_join("m.slots", ",").alias("slots"), "m.food", "m.days", "m.decoded")


_LAB_SQL = f"""SELECT k, n, CASE WHEN f IN ('H') THEN 'High' WHEN f = 'low' THEN 'Low' WHEN f = 'In Range' THEN 'In range' ELSE
  CASE n % 7 WHEN 0 THEN CASE WHEN v > 40 THEN 'Above range' WHEN v < 10 THEN 'Below range' ELSE '' END WHEN 1 THEN CASE WHEN v >= 30 THEN 'Above range' ELSE '' END WHEN 2 THEN CASE WHEN v < 20 THEN 'Below range' ELSE '' END
  WHEN 3 THEN CASE WHEN v < 20 THEN 'Desirable' WHEN v <= 35 THEN 'Borderline High' ELSE 'High' END WHEN 6 THEN CASE WHEN v < 12 THEN 'Deficiency' WHEN v <= 20 THEN 'Insufficiency' ELSE 'Sufficiency' END END END AS label
FROM (SELECT l_orderkey AS k, l_linenumber AS n, floor(l_quantity) AS v, {LAB_FLAG} AS f FROM lineitem)"""


@query(f"SELECT k AS l_orderkey, n AS l_linenumber, label, coalesce(label IN ('High', 'Low', 'Above range', 'Below range', 'Borderline High', 'Deficiency', 'Insufficiency'), NULL) AS outside FROM ({_LAB_SQL})")
def lab_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{LAB_VALUE} AS v", f"{LAB_RANGE} AS r", f"{LAB_FLAG} AS f")
    rows = rows.withColumn("a", decoders.lab_value(F.col("v"), F.col("r"), F.col("f")))
    return rows.select("l_orderkey", "l_linenumber", "a.label", "a.outside")


@query(f"SELECT k AS l_orderkey, CAST(count(*) FILTER (label IN ('High', 'Low', 'Above range', 'Below range', 'Borderline High', 'Deficiency', 'Insufficiency')) AS BIGINT) AS outside, CAST(count(label) AS BIGINT) AS decided FROM ({_LAB_SQL}) GROUP BY k")
def lab_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab_values(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if("outside").alias("outside"), F.count("label").alias("decided"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'loan' ELSE CASE p_partkey % 12 WHEN 2 THEN 'discharge_summary' ELSE CASE WHEN p_size % 10 = 0 AND p_size % 4 <> 0 THEN 'prescription' WHEN p_size % 4 = 0 THEN 'lab_report' ELSE
  CASE p_partkey % 12 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'prescription' WHEN 3 THEN 'utility_bill' WHEN 4 THEN 'pension_notice' WHEN 5 THEN 'insurance' WHEN 6 THEN 'loan' WHEN 7 THEN 'school' WHEN 10 THEN 'investment' ELSE 'other' END END END END AS kind FROM part"""
)
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 50 = 0 THEN 'Loan' ELSE 'odd' END AS given", f"{TITLE} AS t", "CASE WHEN p_size % 10 = 0 THEN 2 ELSE 0 END AS m", "CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS s")
    return rows.select("p_partkey", decoders.document_kind(F.col("given"), F.col("t"), F.col("m"), F.col("s")).alias("kind"))


@query(
    f"""SELECT g AS filter_group, count(*) AS n FROM (SELECT CASE WHEN k = 'lab_report' THEN 'health' WHEN k IN ('insurance', 'bank') OR event_id % 97 = 0 THEN 'money' WHEN k = 'form' THEN 'forms' END AS g
FROM (SELECT event_id, {KIND} AS k FROM events)) GROUP BY g"""
)
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(f"{KIND} AS k", "CASE WHEN event_id % 97 = 0 THEN 'My Pension' ELSE 'x' END AS title")
    return rows.groupBy(decoders.filter_group(F.col("k"), F.col("title")).alias("filter_group")).agg(F.count(F.lit(1)).alias("n"))
