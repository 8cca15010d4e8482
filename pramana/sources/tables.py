"""Sources: the input tables, and stand-ins for document data derived from them.

The expressions are plain SQL that any engine reads alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for a core, where rows are dealt out.
SPREAD = 4


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` dealt out to all cores by a key: the file of a narrow table is few tasks, however many rows it has, and work on a row may be slow."""
    return rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, key)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """PDF, JPEG and PNG files below a folder: path, length and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(r"lower(path) rlike '\\.(pdf|jpe?g|png)$'").select("path", "length", "content")


def results_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Saved results, one JSON object in each file; bodies without a title are left out."""
    return spark.read.schema(schema).option("multiLine", "true").json(folder).where("title IS NOT NULL")


def feedback_json(spark: SparkSession, folder: str) -> DataFrame:
    """Saved feedback, one JSON object in each line; empty objects give rows of nulls."""
    schema = "rating string, lang string, docType string, reasons array<string>, sample boolean, appVersion string, createdAt timestamp"
    return spark.read.schema(schema).json(folder)


_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
DAY, MONTH, YEAR = f"substr({_ISO}, 9, 2)", f"substr({_ISO}, 6, 2)", f"substr({_ISO}, 1, 4)"
WHOLE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
GROUPED = f"CASE WHEN length({WHOLE}) > 3 THEN substr({WHOLE}, 1, length({WHOLE}) - 3) || ',' || substr({WHOLE}, length({WHOLE}) - 2, 3) ELSE {WHOLE} END"
DATE_TEXT = (
    f"CASE o_orderkey % 6 WHEN 0 THEN {_ISO} WHEN 1 THEN {DAY} || '.' || {MONTH} || '.' || {YEAR} WHEN 2 THEN {DAY} || ' October ' || {YEAR} "
    f"WHEN 3 THEN 'Oct ' || {DAY} || ', ' || {YEAR} WHEN 4 THEN '31/02/' || {YEAR} ELSE 'soon' END"
)
AMOUNT_TEXT = f"CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || {GROUPED} WHEN 1 THEN 'INR ' || {GROUPED} || '.00' WHEN 2 THEN '₹ ' || {WHOLE} ELSE 'Rs. ' || translate({GROUPED}, '0123456789', '०१२३४५६७८९') END"
LETTER = (
    f"'Please pay ' || {AMOUNT_TEXT} || ' before ' || {DAY} || '.' || {MONTH} || '.' || {YEAR} || '. Call 1800 200 ' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || "
    f"' about claim CLM-' || CAST(o_orderkey AS STRING) || '. Two  lacs, 3/4 done.'"
)
TRANSLATED = f"CASE o_orderkey % 5 WHEN 0 THEN replace({LETTER}, '.', ' ') WHEN 1 THEN translate({LETTER}, '0123456789', '௦௧௨௩௪௫௬௭௮௯') WHEN 2 THEN replace({LETTER}, '1', '7') WHEN 3 THEN '' ELSE {LETTER} END"
SPAN_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN 'within ' || CAST(o_custkey % 90 AS STRING) || ' hours' WHEN 1 THEN 'Reply within ' || CAST(o_custkey % 40 AS STRING) || ' days.' WHEN 2 THEN 'within two weeks' WHEN 3 THEN 'Within ' || CAST(o_custkey % 14 AS STRING) || ' months of this letter' WHEN 4 THEN 'open 24 hours' ELSE 'within a week' END"
FREQUENCY = (
    "CASE p_partkey % 18 WHEN 0 THEN '1-0-1' WHEN 1 THEN '1-1-1 after food' WHEN 2 THEN '0-0-1 at bedtime' WHEN 3 THEN '1-1-1-1' WHEN 4 THEN '0-1-0' WHEN 5 THEN 'OD x 10 days' WHEN 6 THEN 'BD for 2 weeks' "
    "WHEN 7 THEN 'tds before meals' WHEN 8 THEN 'QID' WHEN 9 THEN 'HS' WHEN 10 THEN 'SOS' WHEN 11 THEN 'once a week' WHEN 12 THEN 'as directed' WHEN 13 THEN 'Twice daily for 1 month' WHEN 14 THEN '' WHEN 15 THEN 'PRN pc' WHEN 16 THEN '2/0/1' ELSE 'alternate days' END"
)
LAB_RANGE = (
    "CASE l_linenumber % 7 WHEN 0 THEN '10 - 40' WHEN 1 THEN '< 30' WHEN 2 THEN '>= 20' WHEN 3 THEN 'Desirable: < 20; Borderline High: 20-35; High: > 35' "
    "WHEN 4 THEN 'Indicative of renal impairment < 60' WHEN 5 THEN '' ELSE 'Deficiency: < 12; Insufficiency: 12-20; Sufficiency: 20-100' END"
)
LAB_FLAG = "CASE WHEN l_orderkey % 11 = 0 THEN 'H' WHEN l_orderkey % 13 = 0 THEN 'low' WHEN l_orderkey % 17 = 0 THEN 'In Range' ELSE '' END"
LAB_VALUE = "CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING)"
TITLE = (
    "CASE p_partkey % 12 WHEN 0 THEN 'Lab report of haemoglobin' WHEN 1 THEN 'Take BD after food' WHEN 2 THEN 'Advice on discharge' WHEN 3 THEN 'Electricity for May' WHEN 4 THEN 'Jeevan Pramaan' "
    "WHEN 5 THEN 'Your claim and policy' WHEN 6 THEN 'EMI (sanction)' WHEN 7 THEN 'College tuition' WHEN 8 THEN 'MONTHLY RENT NOTICE' WHEN 9 THEN 'snav chart' WHEN 10 THEN 'NAV, folio 12' ELSE 'Hello' END"
)
ENDPOINT = "event_type"
RATING = "CASE WHEN event_id % 3 = 0 THEN 'down' WHEN event_id % 7 = 0 THEN NULL ELSE 'up' END"
KIND = "CASE event_id % 5 WHEN 0 THEN 'insurance' WHEN 1 THEN 'bank' WHEN 2 THEN 'lab_report' WHEN 3 THEN NULL ELSE 'form' END"
