"""Queries of amounts due, medicines, reminders, activity and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dues
from ..sources.tables import table
from .registry import query

_PAIRS = (
    "array(struct('Plan rental' AS label, 'Rs. 5' AS value, 'amount' AS kind), struct(CASE WHEN o_orderkey % 3 = 0 THEN 'Total due' ELSE 'Paid on time' END AS label, 'Rs. ' || CAST(o_custkey AS STRING) AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'date' ELSE 'amount' END AS kind), "
    "struct('Received' AS label, '₹12' AS value, 'text' AS kind), struct('Amount paid' AS label, '₹12' AS value, 'text' AS kind))"
)


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AND o_custkey > 0 THEN 'Rs. ' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN '₹77' WHEN o_orderkey % 5 > 0 AND o_custkey > 0 THEN 'Rs. ' || CAST(o_custkey AS VARCHAR) ELSE '₹12' END AS due, CASE WHEN o_orderkey % 3 = 0 THEN '₹12' ELSE 'Rs. ' || CAST(o_custkey AS VARCHAR) || '|₹12' END AS paid FROM orders"
)
def amounts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_PAIRS} AS p", "CASE WHEN o_orderkey % 2 = 0 THEN '₹77' ELSE 'see page 2' END AS emi")
    return rows.select("o_orderkey", dues.amount_due(F.col("p"), [F.col("emi")]).alias("due"), F.array_join(dues.paid_amounts(F.col("p")), "|").alias("paid"))


@query("SELECT p_partkey, p_name || ':TDS:' || CASE WHEN p_partkey % 3 = 0 THEN 'check_original' ELSE 'matched' END || '|Other:SOS:' || CASE WHEN p_partkey % 3 = 1 THEN 'matched' ELSE 'check_original' END AS found FROM part")
def medicine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat(array(struct(' ' || p_name || ' ' AS name, 'tds' AS frequency, '' AS quote), struct('Other' AS name, 'sos' AS frequency, 'as needed' AS quote), struct(' ' AS name, 'od' AS frequency, '' AS quote)), array_repeat(struct('' AS name, '' AS frequency, '' AS quote), 9), array(struct('Late' AS name, 'od' AS frequency, '' AS quote))) AS m",
        "CASE p_partkey % 3 WHEN 1 THEN upper(p_name) || ' as needed' ELSE 'take ' || p_name END AS t", "p_partkey % 3 = 0 AS photo",
    )
    found = dues.medicines(F.col("m"), F.col("t"), F.col("photo"))
    return rows.select("p_partkey", F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["name"], m["code"], m["evidence"])), "|").alias("found"))


@query(
    """SELECT o_orderkey AS id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'by date' WHEN o_orderkey % 3 = 1 THEN 'by place' ELSE o_orderpriority END ELSE 'second' END AS summary, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderdate < DATE '1997-06-15' OR p = 1 THEN 'past' ELSE 'upcoming' END AS status FROM orders, (VALUES (0), (1)) v(p)"""
)
def reminder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    action = lambda text, due, status: F.struct(text.alias("text"), due.alias("due"), F.lit(status).alias("status"))
    word = lambda text, due: F.struct(F.lit(text).alias("text"), due.alias("due"))
    k = F.col("o_orderkey")
    by_date, by_place = F.array(word("x", F.lit("1900-01-01")), word("by date", day)), F.array(word("by place", F.lit("1900-01-01")))
    none = F.array().cast("array<struct<text:string,due:string>>")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.array(action(F.col("o_orderpriority"), day, "upcoming"), action(F.lit("gone"), F.lit(None).cast("string"), "none")).alias("actions"), F.when(k % 3 == 0, by_date).when(k % 3 == 1, by_place).otherwise(none).alias("translated")
    )
    second = table(spark, sf_dir, "orders").select(k.alias("id"), F.array(action(F.lit("x"), F.lit("soon"), "none"), action(F.lit("  second "), day, "passed")).alias("actions"), none.alias("translated"))
    return dues.reminder_rows(rows.unionByName(second), "1997-06-15")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS done, CASE WHEN c_custkey % 6 = 0 THEN 'down' WHEN c_custkey % 9 = 0 THEN '' ELSE 'up' END AS rating FROM customer")
def merged_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "map('a', true) AS done", "'up' AS rating")
    patches = rows.where("c_custkey % 3 = 0").selectExpr("c_custkey", "map('b', true) AS done", "CASE WHEN c_custkey % 6 = 0 THEN 'down' END AS rating", "c_custkey % 6 = 0 OR c_custkey % 9 = 0 AS has_rating")
    return dues.merged_activity(rows, patches, "c_custkey").select("c_custkey", F.array_join(F.map_keys("done"), ",").alias("done"), "rating")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || ' Ask a doctor.' ELSE 'Ask a doctor. ' || p_name END AS answer FROM part")
def closed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 2, F.concat(F.lit("Ask a doctor. "), "p_name")).otherwise(F.concat("p_name", F.when(k % 3 == 1, "  ").otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", dues.closed_answer(text, F.when(k % 3 > 0, "Ask a doctor.")).alias("answer"))


@query(
    """SELECT conv_id, substr(string_agg('Q: ' || CAST(turn AS VARCHAR), chr(10) ORDER BY turn), 1, 4000) AS history FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE n <= 8 GROUP BY conv_id"""
)
def question_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))  # no more turns than the history keeps are gathered
    last = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("n", newest).where("n <= 8")
    turns = last.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    history = F.array_join(F.transform("t", lambda t: F.concat(F.lit("Q: "), t.cast("string"))), "\n")
    return turns.select("conv_id", dues.last_blocks(history).alias("history"))


@query("SELECT p_partkey, 'one two three four five six seven eight|' || p_brand || '|' || 'z' AS asked FROM part")
def follow_up_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.lit(" "), F.lit("one two three  four five six seven eight nine"), F.lit(None), F.col("p_brand"), F.lit("z"), F.lit("late"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(dues.follow_ups(items), "|").alias("asked"))
