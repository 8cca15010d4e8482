"""Queries of operators on tables of results: order, packets, stores, evaluations, keyed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import admission, decoders, dues, evals, evidence, feed, guards, overview, results, stores
from ..sources.tables import table
from .registry import query
from .stream_queries import scratch


@query(
    """SELECT l_orderkey, CASE WHEN pdfs > 0 AND photos > 0 THEN 'mixed' WHEN photos > 10 THEN 'too_many_photos' WHEN pdfs > 5 THEN 'too_many_pdfs' WHEN bytes > 26214400 THEN 'pdfs_too_large' ELSE 'ok' END AS code,
  pdfs = 0 AND photos BETWEEN 1 AND 9 AS more_photos
FROM (SELECT l_orderkey, count(*) FILTER (WHERE p) AS pdfs, count(*) FILTER (WHERE NOT p) AS photos, coalesce(sum(CASE WHEN p THEN b END), 0) AS bytes
  FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 = 0 ELSE l_orderkey % 3 = 1 END AS p, CAST(l_quantity AS BIGINT) * 200000 AS b FROM lineitem) GROUP BY l_orderkey)"""
)
def tray_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trays of files: photos, PDFs, or both."""
    files = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 = 0 ELSE l_orderkey % 3 = 1 END AS is_pdf", "CAST(l_quantity AS BIGINT) * 200000 AS bytes")
    return admission.tray_code(files, "l_orderkey")


@query("SELECT l_orderkey, coalesce(bool_and(l_returnflag = 'N'), false) AS all_matched FROM lineitem GROUP BY l_orderkey")
def values_all_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "matched").alias("evidence"))
    return overview.all_matched(rows, "l_orderkey")


@query(
    """SELECT doc_id, section, pos, label, value, flag, page FROM (
  SELECT l_orderkey AS doc_id, l_returnflag AS section, l_linenumber AS pos, 'v' || CAST(l_linenumber AS VARCHAR) AS label, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, l_linenumber % 3 AS page,
    CASE WHEN l_orderkey % 5 = 0 THEN 'High' WHEN CAST(l_quantity AS BIGINT) > 40 THEN 'Above range' WHEN CAST(l_quantity AS BIGINT) < 10 THEN 'Below range' END AS flag FROM lineitem) WHERE flag IS NOT NULL"""
)
def flagged_lab_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their range or flagged in print, over all sections."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_returnflag AS section", "l_linenumber AS pos", "'v' || CAST(l_linenumber AS STRING) AS label", "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS value", "'10 - 40' AS ref_range", "CASE WHEN l_orderkey % 5 = 0 THEN 'H' ELSE '' END AS flag", "l_linenumber % 3 AS page")
    return overview.flagged_values(rows)


@query("SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey % 4 END, l_linenumber) AS INTEGER) AS place FROM lineitem")
def sections_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS pos", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey % 4 END AS page")
    return overview.section_order(rows).select("doc_id", "pos", "place")


_REMINDERS = "SELECT o_custkey AS owner, o_orderkey AS pos, 'r' || CAST(o_orderkey AS STRING) AS summary, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '09:00' END AS time, CASE WHEN o_orderkey % 4 = 0 THEN 'past' ELSE 'upcoming' END AS status FROM {}"
_SQL_REMINDERS = _REMINDERS.format("orders").replace("STRING", "VARCHAR")


@query(f"SELECT owner, arg_min(summary, (date || 'T' || coalesce(nullif(time, ''), '00:00'), pos)) AS summary, min(date) AS date FROM ({_SQL_REMINDERS}) WHERE status = 'upcoming' GROUP BY owner")
def next_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.next_up(spark.sql(_REMINDERS.format("{orders}"), orders=table(spark, sf_dir, "orders")), "owner")


@query(
    f"""SELECT owner, pos, CAST(row_number() OVER (PARTITION BY owner ORDER BY date || 'T' || coalesce(nullif(time, ''), '00:00'), pos) AS INTEGER) AS place, status FROM ({_SQL_REMINDERS}) WHERE status = 'upcoming'
UNION ALL SELECT owner, pos, CAST(row_number() OVER (PARTITION BY owner ORDER BY date || 'T' || coalesce(nullif(time, ''), '00:00') DESC, pos) AS INTEGER), status FROM ({_SQL_REMINDERS}) WHERE status = 'past'"""
)
def ordered_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming reminders by time, past ones the latest first."""
    rows = spark.sql(_REMINDERS.format("{orders}"), orders=table(spark, sf_dir, "orders"))
    both = overview.reminder_order(rows, "owner").unionByName(overview.reminder_order(rows, "owner", past=True))
    return both.select("owner", "pos", "place", "status")


@query(
    """SELECT l_orderkey, CASE WHEN n > 1 AND t NOT LIKE '%reports' THEN t || ' + ' || CAST(n - 1 AS VARCHAR) || ' more' ELSE CAST(n AS VARCHAR) || ' reports' END AS title, ready, first_ready, bytes, pages
FROM (SELECT l_orderkey, count(*) AS n, coalesce(arg_min(CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_orderkey % 7 = 0 THEN '3 reports' ELSE 'T' || CAST(l_linenumber AS VARCHAR) END END, l_linenumber) FILTER (WHERE l_linenumber % 2 = 0), arg_min('f' || CAST(l_linenumber AS VARCHAR), l_linenumber)) AS t,
  count(*) FILTER (WHERE l_returnflag = 'N') AS ready, min(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS first_ready, CAST(sum(l_partkey) AS BIGINT) AS bytes, CAST(sum(l_linenumber) AS BIGINT) AS pages FROM lineitem GROUP BY l_orderkey)"""
)
def report_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several reports as one packet, with totals."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber AS pos", "CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_orderkey % 7 = 0 THEN '3 reports' ELSE 'T' || CAST(l_linenumber AS STRING) END ELSE '' END AS title", "'f' || CAST(l_linenumber AS STRING) AS file",
        "CASE WHEN l_returnflag = 'N' THEN 'ready' ELSE 'pending' END AS status", "l_partkey AS bytes", "CAST(l_linenumber AS BIGINT) AS pages",
    )
    return overview.packets(rows, "l_orderkey")


@query(
    """WITH w AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) * 1.0 / sum(length(text)) OVER (PARTITION BY conv_id) AS e FROM conversations WHERE text <> '')
SELECT conv_id, min(turn) FILTER (WHERE 0.5 <= e) AS active FROM w GROUP BY conv_id"""
)
def active_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sounds at half time, if turns are read one after the other."""
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", F.col("turn").alias("pos"), "text")
    return overview.active_sentence(rows, "conv_id", F.lit(0.5))


@query(
    """WITH a AS (SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS title, o_orderdate AS made FROM orders)
SELECT owner, id, title FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY made DESC, id) AS n FROM a) WHERE n <= 4"""
)
def upserted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New results replace saved ones of their id; each owner keeps the newest four."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.lit("old").alias("title"), F.col("o_orderdate").alias("at"))
    new = rows.where("id % 3 = 0").withColumn("title", F.lit("new"))
    return stores.upserted(rows.where("id % 6 <> 3"), new, "owner", "id", "at", 4).select("owner", "id", "title")


@query("SELECT 'recents' AS store, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'originals', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def deleted_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted results go from every store."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    left = stores.cascaded({"recents": orders, "originals": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))}, orders.where("id % 5 = 0"), "id")
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey = 17")
def one_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up by key: the filter reaches the scan."""
    return stores.lookup(spark, f"{sf_dir}/part.parquet", "p_partkey", 17).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'read ' || p_name END AS value FROM part")
def cached_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached readings by digest, version and language."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("content"), "p_name")
    asked = parts.select("p_partkey", F.concat("content", F.encode(F.col("p_partkey").cast("string"), "UTF-8")).alias("content"), F.lit(4).alias("version"), F.when(F.col("p_partkey") % 2 == 0, "ta").otherwise("en").alias("lang"))
    cache = parts.where("p_partkey % 3 = 0").select(F.concat(F.sha2(F.concat("content", F.encode(F.col("p_partkey").cast("string"), "UTF-8")), 256), F.lit(":4")).alias("cache_key"), F.lit("ta").alias("lang"), F.concat(F.lit("read "), "p_name").alias("value"))
    return stores.cached_readings(asked, cache).select("p_partkey", "value")


@query("SELECT l_orderkey, sha256(string_agg('f' || CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber)) AS digest FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey")
def uploads_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for the files of each upload."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("p"))
    return stores.files_digest(files.select("l_orderkey", "pos", F.encode(F.concat(F.lit("f"), F.col("p").cast("string")), "UTF-8").alias("content")), "l_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ta' WHEN p_partkey % 3 <> 0 THEN 'en' END AS shown_lang FROM part")
def bundled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundled results in the asked language, else in English; bodies that are no object or lack a title do not count."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("file"))
    good, bad = F.lit(' {"title": "T"}'), F.lit('{"title": ""}')
    bodies = parts.where("p_partkey % 4 = 0").select("file", F.lit("ta").alias("lang"), good.alias("body")).unionByName(parts.select("file", F.lit("en").alias("lang"), F.when(F.col("p_partkey") % 3 == 0, bad).otherwise(good).alias("body")))
    return stores.sample_results(bodies, parts.select("p_partkey", "file", F.lit("ta").alias("lang"))).join(parts, "file").select("p_partkey", "shown_lang")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE event_id % 2 = 0) GROUP BY event_type")
def appended_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows added to a table in two writes."""
    path, rows = scratch(spark, "feedback"), table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (rows, rows.where("event_id % 2 = 0")):
        stores.append_feedback(part, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_WORDS = r"regexp_extract(text, '^\s*((?:\S+\s+){3}\S+)', 1)"
_NORMAL = r"trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '\b([Ll][Aa][Cc][Ss]?|[Ll][Aa][Kk][Hh][Ss]?)\b', 'lakh', 'g'), '(\d)[,](\d)', '\1\2', 'g')))"


@query(
    f"WITH own AS (SELECT doc_id, {_NORMAL.format('text')} AS t, {_NORMAL.format(_WORDS)} AS first FROM documents WHERE length(text) > 60), asked AS (SELECT own.doc_id, own.t, own.first, other.first AS foreign_words FROM own LEFT JOIN own other ON other.doc_id = own.doc_id + 1) "
    "SELECT doc_id, CAST(CASE WHEN contains(t, 'never said 918273645') THEN 0 ELSE 1 END + CASE WHEN first = '' OR contains(t, first) THEN 0 ELSE 1 END + CASE WHEN coalesce(foreign_words, '') = '' OR contains(t, foreign_words) THEN 0 ELSE 1 END AS INTEGER) AS wrongly_matched FROM asked"
)
def wrongly_matched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items called matched: a number that is nowhere, the first four words of the document, and those of the next one, which only copies hold; besides one that is not called so."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 60").select("doc_id", "text")
    own = docs.select("doc_id", F.regexp_extract("text", r"^\s*((?:\S+\s+){3}\S+)", 1).alias("first"))
    following = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("first").alias("next_first"))
    quotes = F.array(F.lit("never said 918273645"), F.col("first"), F.coalesce("next_first", F.lit("")), F.lit("unmatched"))
    items = own.join(following, "doc_id", "left").select("doc_id", F.explode(quotes).alias("quote"))
    items = items.withColumn("evidence", F.when(F.col("quote") == "unmatched", "check_original").otherwise("matched"))
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text")
    return evals.wrongly_matched(items, pages, unicode_forms=False)


@query(
    """SELECT p_partkey, NOT (p_partkey % 2 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS passed,
  CASE WHEN p_partkey % 2 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN 'All checks passed'
    ELSE array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'document_type' END, CASE WHEN p_partkey % 5 = 0 THEN 'excluded: Desk' END, CASE WHEN p_partkey % 7 = 0 THEN 'wrongly_matched=3' END, CASE WHEN p_partkey % 3 = 0 THEN 'missing: CLM' END], lambda x: x IS NOT NULL), ', ') END AS notes FROM part"""
)
def eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against what their cases expect."""
    k = F.col("p_partkey")
    kept = F.filter(F.array(F.when(k % 5 == 0, "Desk"), F.when(k % 3 != 0, "CLM")), lambda x: x.isNotNull())
    result = F.struct(F.when(k % 2 == 0, "bank").otherwise("loan").alias("document_type"), F.lit("text_pdf").alias("source_kind"), kept.alias("protected_terms"))
    expected = F.struct(F.lit("loan").alias("document_type"), F.lit("text_pdf").alias("source_kind"), F.array(F.lit("CLM")).alias("protected_terms"), F.array(F.lit("Desk")).alias("excluded_protected_terms"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(evals.case_verdict(result, expected, F.when(k % 7 == 0, 3).otherwise(0)))).alias("v"))
    return found.select("p_partkey", "v.passed", "v.notes")


@query("SELECT p_name AS name, '| ' || p_name || ' | ' || p_type || ' | ' || CAST(p_size AS VARCHAR) || '.00 | 0 | ' || CASE WHEN p_size % 2 = 0 THEN '**PASS**' ELSE '**FAIL**' END || ' | - |' AS line FROM part")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_name AS name", "p_type AS document_type", "CAST(p_size AS DOUBLE) AS seconds", "0 AS wrongly_matched", "p_size % 2 = 0 AS passed", "'' AS notes")
    return evals.report_lines(rows)


@query("SELECT l AS lang, p_name AS key FROM (SELECT DISTINCT p_name, min(p_partkey) AS k FROM part GROUP BY p_name), (SELECT unnest(['ta', 'hi']) AS l) WHERE NOT (l = 'ta' AND k % 3 = 0) AND NOT (l = 'hi' AND k % 4 = 0)")
def missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the English dictionary that others lack."""
    keys = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("k"))
    words = keys.select(F.lit("en").alias("lang"), "key").unionByName(keys.where("k % 3 = 0").select(F.lit("ta").alias("lang"), "key")).unionByName(keys.where("k % 4 = 0").select(F.lit("hi").alias("lang"), "key"))
    return evals.words_missing(words, ["ta", "hi"])


@query("SELECT p_partkey AS file, l AS lang, CAST(n AS INTEGER) AS place FROM part, (SELECT unnest(['en', 'ta', 'hi']) AS l, unnest([0, 1, 2]) AS n) WHERE NOT (l = 'en' AND p_partkey % 2 = 0)")
def results_to_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundled results that have not been built yet."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"))
    return evals.still_to_build(files, ["ta", "en", "hi"], files.where("file % 2 = 0").select("file", F.lit("en").alias("lang")))


_WHOLE_RESULT = [
    "doc_id", "'Title ' || CAST(doc_id AS STRING) AS title", "CASE WHEN doc_id % 2 = 0 THEN lang END AS report_title", "CASE WHEN doc_id % 5 = 0 THEN source END AS unreadable_reason", "substr(text, 1, 9) AS glance_headline", "CASE WHEN doc_id % 4 > 0 THEN substr(text, 5, 9) ELSE '' END AS spoken_summary",
    "array(substr(text, 1, 20), NULL) AS summary", "array(named_struct('text', 'act', 'deadline_rule', CASE WHEN doc_id % 3 = 0 THEN 'rule' END, 'recurrence', ''), named_struct('text', NULL, 'deadline_rule', '', 'recurrence', lang)) AS actions", "array(lang, NULL) AS warnings", "array(source) AS facts",
    "CASE WHEN doc_id % 2 = 0 THEN array('c', '') END AS conflicts", "array(lang, source) AS key_labels", "array('') AS places", "array(NULL, 'phone') AS contacts", "array('', lang) AS instructions", "array(named_struct('name', source, 'instruction', ''), named_struct('name', '', 'instruction', lang)) AS form_fields",
    "array(named_struct('heading', lang, 'labels', array('a', '')), named_struct('heading', '', 'labels', array(source))) AS sections", "array(named_struct('title', source, 'summary_lines', array('l', NULL), 'headings', array('', lang))) AS parts",
]
# Keys of that result with their texts in DuckDB, and whether a blank text has a key.
_WHOLE_KEYS = [
    ("title", "'Title ' || doc_id", True), ("report_title", "CASE WHEN doc_id % 2 = 0 THEN lang END", False), ("unreadable_reason", "CASE WHEN doc_id % 5 = 0 THEN source END", False), ("glance_headline", "substr(text, 1, 9)", True), ("spoken_summary", "CASE WHEN doc_id % 4 > 0 THEN substr(text, 5, 9) END", False),
    ("summary_0", "substr(text, 1, 20)", True), ("summary_1", "''", True), ("action_0_text", "'act'", True), ("action_1_text", "''", True), ("action_0_rule", "CASE WHEN doc_id % 3 = 0 THEN 'rule' END", False), ("action_1_recurrence", "lang", False), ("warning_0_text", "lang", True), ("warning_1_text", "''", True),
    ("fact_0_text", "source", True), ("glance_kv_0_label", "lang", True), ("glance_kv_1_label", "source", True), ("place_0_label", "''", True), ("contact_0_label", "''", True), ("contact_1_label", "'phone'", True), ("med_1_instruction", "lang", False), ("form_0_name", "source", False),
    ("form_1_instruction", "lang", False), ("section_0_heading", "lang", False), ("section_0_value_0_label", "'a'", False), ("section_1_value_0_label", "source", False), ("part_0_title", "source", False), ("part_0_summary_0", "'l'", True), ("part_0_summary_1", "''", True), ("part_0_section_1", "lang", False),
]


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{key}' AS key, coalesce({value}, '') AS value FROM documents" + ("" if always else f" WHERE coalesce({value}, '') <> ''") for key, value, always in _WHOLE_KEYS)
    + " UNION ALL SELECT doc_id, unnest(['conflict_0', 'conflict_1']), unnest(['c', '']) FROM documents WHERE doc_id % 2 = 0)"
)
def all_translatable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that have every kind of text, some of them blank: every key there is."""
    return guards.all_keyed_strings(table(spark, sf_dir, "documents").selectExpr(*_WHOLE_RESULT))


_RESULT = "doc_id, 'Title ' || CAST(doc_id AS STRING) AS title, CASE WHEN doc_id % 2 = 0 THEN 'R' END AS report_title, array(substr(text, 1, 20), 'two') AS summary, array(named_struct('text', 'act', 'deadline_rule', CASE WHEN doc_id % 3 = 0 THEN 'rule' END)) AS actions, array(named_struct('title', '', 'summary_lines', array('l'), 'headings', array('h', '')) ) AS parts"


@query(
    """SELECT * FROM (SELECT doc_id, 'title' AS key, 'Title ' || CAST(doc_id AS VARCHAR) AS value FROM documents UNION ALL SELECT doc_id, 'report_title', 'R' FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'summary_0', coalesce(substr(text, 1, 20), '') FROM documents UNION ALL SELECT doc_id, 'summary_1', 'two' FROM documents UNION ALL SELECT doc_id, 'action_0_text', 'act' FROM documents
  UNION ALL SELECT doc_id, 'action_0_rule', 'rule' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'part_0_summary_0', 'l' FROM documents UNION ALL SELECT doc_id, 'part_0_section_0', 'h' FROM documents)"""
)
def translatable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every translatable text of a result as a keyed row."""
    return guards.all_keyed_strings(table(spark, sf_dir, "documents").selectExpr(*_split_top(_RESULT)))


def _split_top(text: str) -> list[str]:
    """Expressions at the outermost commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'digit' WHEN o_orderkey % 7 = 0 THEN 'other' WHEN o_orderkey % 3 = 0 THEN 'protected_terms' END AS kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'title' WHEN o_orderkey % 7 = 0 THEN 'actions_length' WHEN o_orderkey % 3 = 0 THEN 'protected_terms' END AS field FROM orders"""
)
def translation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure of each translated result: numbers, then lengths, then protected terms."""
    k = F.col("doc_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    text = F.concat(F.lit("Pay 5 to Asha Rao, order "), k.cast("string"))
    original = orders.select("doc_id", F.lit(0).alias("place"), F.lit("title").alias("key"), text.alias("value"))
    translated = orders.select("doc_id", F.lit(0).alias("place"), F.lit("title").alias("key"), F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("5 "), F.when(k % 3 == 0, "").otherwise("asha  rao "), k.cast("string"))).alias("value"))
    lengths = orders.select("doc_id", F.lit(1).alias("place"), F.lit("actions_length").alias("field"), (k % 7 != 0).alias("same"))
    return guards.guard_failures(original, translated, lengths, orders.select("doc_id", F.array(F.lit("Asha Rao"), F.lit("Office")).alias("terms"))).select("doc_id", "kind", "field")


@query(
    """SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'check_original' WHEN 2 THEN 'matched' ELSE 'check_original' END AS evidence FROM orders"""
)
def quoted_lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab rows by their quote, or by label and value where there is none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    pages = orders.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Iron 86 ug High, number "), F.col("doc_id").cast("string")).alias("text"))
    by = lambda *x: F.element_at(F.array(*(F.lit(y) for y in x)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = orders.select("doc_id", F.lit(0).alias("pos"), by("Iron", "Iron", " iron", "Zinc").alias("label"), by("86", "86", "86", "86").alias("value"), by("Iron 86 ug", "Iron 87", "", " ").alias("quote"), F.lit(1).alias("page"))
    return evidence.quoted_lab_rows(rows, pages, unicode_forms=False).select("doc_id", "pos", "evidence")


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS kept FROM (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders) WHERE b <= 300000) WHERE s <= 300000 GROUP BY o_custkey")
def originals_within_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest files of an owner up to a number of bytes; a larger one is left out by itself."""
    rows = table(spark, sf_dir, "orders").withColumn("b", F.floor("o_totalprice"))
    kept = feed.within_bytes(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], "b", 300_000)
    return kept.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("kept"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS pos, lower(a) AS address FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey, a FROM (SELECT o_custkey, o_orderkey, 'road ' || CAST(o_orderkey % 9 AS VARCHAR) AS a FROM orders WHERE o_orderkey % 9 > 0) GROUP BY o_custkey, a)) WHERE n <= 5")
def distinct_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five places, each address once."""
    text = "CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN 'Road  ' ELSE 'road ' END || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_orderkey % 9 AS STRING) END"
    found = feed.distinct_places(table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS pos", f"{text} AS address"))
    return found.select("doc_id", "pos", F.lower(F.regexp_replace("address", r"\s+", " ")).alias("address"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN v < 10 THEN 'M' || CAST(v AS VARCHAR) || '@x.co' ELSE '98765 4321' || CAST(v % 10 AS VARCHAR) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT o_custkey, v, min(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderkey % 17 AS v FROM orders WHERE o_orderkey % 17 < 14) GROUP BY o_custkey, v)) WHERE n <= 6")
def distinct_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six valid contacts, each once."""
    v = "o_orderkey % 17"
    text = f"CASE WHEN {v} < 10 THEN ' M' || CAST({v} AS STRING) || '@x.co' WHEN {v} < 14 THEN '98765 4321' || CAST({v} % 10 AS STRING) ELSE 'call me' END"
    return feed.distinct_contacts(table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS pos", f"{text} AS value")).select("doc_id", "pos", "value")


@query("SELECT coalesce(g, 'all') AS filter_group, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'money' WHEN 1 THEN 'health' WHEN 2 THEN 'bills' END AS g, count(*) AS n FROM events GROUP BY 1) GROUP BY GROUPING SETS ((g), ()) HAVING g IS NOT NULL OR grouping(g) = 1")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of filter groups and of all; rows without a group count in all only."""
    k = F.col("event_id") % 4
    return feed.library_totals(table(spark, sf_dir, "events"), F.when(k == 0, "money").when(k == 1, "health").when(k == 2, "bills"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND (event_type LIKE '%ic%' OR event_type = 'view')")
def searched_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group whose type, by its own or its localised name, holds the words."""
    rows = table(spark, sf_dir, "events").withColumn("name", F.lit("x"))
    return feed.searched(rows, " IC", "name", "event_type", {"view": "Basics"}, F.when(F.col("event_id") % 3 == 0, "money"), "money").select("event_id")


@query("SELECT doc_id, part, min(page) AS first, max(page) AS last FROM (SELECT *, page - row_number() OVER (PARTITION BY doc_id, part ORDER BY page) AS r FROM (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_orderkey % 2 END AS part FROM lineitem) WHERE part >= 0) GROUP BY doc_id, part, r")
def owner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages under one owner; a page without an owner ends a run."""
    pages = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "CAST(l_linenumber AS INT) AS page", "CASE WHEN l_linenumber = 3 THEN -1 ELSE l_orderkey % 2 END AS part").distinct()
    return feed.owner_runs(pages)


@query(
    """SELECT l_orderkey AS doc_id, chunk, pos, page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(page, 0), chunk, pos) AS INTEGER) AS place
FROM (SELECT l_orderkey, CAST(l_linenumber % 2 AS INTEGER) AS chunk, l_linenumber AS pos, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_linenumber % 2 = 1 AND l_partkey % 7 <= 5 THEN CAST(l_partkey % 7 + 5 AS INTEGER) ELSE CAST(l_partkey % 7 AS INTEGER) END AS page FROM lineitem)"""
)
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of chunks of five pages as one list, pages shifted."""
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "CAST(l_linenumber % 2 AS INT) AS chunk", "l_linenumber AS pos", "CAST(nullif(l_partkey % 7, 0) AS INT) AS page", "5 AS length")
    return results.merged_chunks(items).select("doc_id", "chunk", "pos", "page", "place")


_CHUNKED = ["l_orderkey AS doc_id", "CAST(l_linenumber % 2 AS INT) AS chunk", "CAST(l_linenumber AS INT) AS pos", "CAST(nullif(l_partkey % 7, 0) AS INT) AS page", "CASE l_suppkey % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'part' WHEN 2 THEN 'action' ELSE 'fact' END AS kind"]


@query(
    f"""WITH i AS (SELECT {', '.join(_CHUNKED)}, min(l_linenumber % 2) OVER (PARTITION BY l_orderkey) AS first_chunk FROM lineitem), k AS (SELECT *, count(*) FILTER (kind = 'part') OVER (PARTITION BY doc_id) AS parts FROM i WHERE kind IN ('section', 'part') OR chunk = first_chunk),
s AS (SELECT doc_id, chunk, pos, kind, CASE WHEN chunk = 1 AND page <= 5 THEN page + 5 ELSE page END AS page FROM k WHERE kind <> 'part' OR parts >= 2)
SELECT doc_id, chunk, pos, kind, page, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY CASE WHEN kind = 'part' THEN 0 ELSE coalesce(page, 0) END, chunk, pos, coalesce(page, 0)) AS INTEGER) AS place FROM s"""
)
def merged_chunks_in_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks merged as the reference does: only sections and parts of later ones stay."""
    items = table(spark, sf_dir, "lineitem").selectExpr(*_CHUNKED, "5 AS length")
    return results.merged_chunks(items, parity=True).select("doc_id", "chunk", "pos", "kind", "page", "place")


@query(
    """SELECT CAST(row_number() OVER (ORDER BY p_partkey) + 6 AS BIGINT) AS place, '| ' || p_name || ' | ' || CASE WHEN p_size % 5 = 0 THEN 'None' ELSE p_type END || ' | text_pdf | ' || printf('%.2f', p_size / 8.0) || ' | 0.00 | ' || (p_size % 3) || ' | ' || CASE WHEN p_size % 2 = 0 THEN '**PASS**' ELSE '**FAIL**' END || ' | All checks passed |' AS line FROM part
UNION ALL SELECT unnest([0, 1, 2, 3, 4, 5, 6, (SELECT count(*) + 7 FROM part)]), unnest(['# Evaluation', '', 'Generated on: 2026-10-06', 'Base URL: `http://localhost`', '', '| Case | Document Type | Source Kind | Explain (s) | Translate (s) | Wrongly Matched | Status | Notes |', '|---|---|---|---|---|---|---|---|', ''])"""
)
def eval_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole report, line by line."""
    cases = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name", "CASE WHEN p_size % 5 > 0 THEN p_type END AS document_type", "'text_pdf' AS source_kind", "p_size / 8.0D AS explain_sec", "CAST(NULL AS DOUBLE) AS translate_sec", "CAST(p_size % 3 AS INT) AS wrongly_matched", "p_size % 2 = 0 AS passed", "'All checks passed' AS notes")
    return evals.report_file(cases, "Evaluation", "2026-10-06", "http://localhost")


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN '0-night' ELSE '1-morning' END AS key, CASE o_orderkey % 3 WHEN 0 THEN 'Take A, Take B' WHEN 1 THEN 'Take A' ELSE 'Take B' END AS summary,
  CASE o_orderkey % 3 WHEN 2 THEN DATE '2026-10-07' ELSE DATE '2026-10-06' END AS date, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '22:15' ELSE '08:00' END AS time FROM orders"""
)
def medicine_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders of selected doses; one for all medicines where no dose is selected."""
    k, none = F.col("o_orderkey") % 3, F.lit(None).cast("string")
    slots = F.when(k == 1, F.create_map(F.lit("0-night"), F.lit(True), F.lit("1-night"), F.lit(False))).when(k == 2, F.create_map(F.lit("1-morning"), F.lit(True))).otherwise(F.create_map(F.lit("0-night"), F.lit(False)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit("A"), F.lit("B"), none).alias("names"), slots.alias("slots"), F.create_map(F.lit("0-night"), F.lit("22:15")).alias("times"))
    return dues.medicine_reminders(rows, F.lit("2026-10-06").cast("date"), F.lit(9 * 60))


@query(
    """SELECT event_type AS endpoint, user_id AS ip, event_id AS id, CASE WHEN NOT ok THEN CAST(greatest(1, floor(60 - (t - first))) AS INTEGER) END AS wait
FROM (SELECT event_type, user_id, event_id, (n - 1) * 10.0 AS t, n % 4 = 1 AS ok, (n - 1 - (n - 1) % 4) * 10.0 AS first, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events)) WHERE n <= 4"""
)
def retry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a rejected caller has to wait: four calls, ten seconds apart, of which the first is allowed."""
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    calls = table(spark, sf_dir, "events").withColumn("n", n).where("n <= 4").select(F.col("event_type").alias("endpoint"), F.col("user_id").alias("ip"), F.col("event_id").alias("id"), ((F.col("n") - 1) * 10.0).cast("double").alias("t"), (F.col("n") % 4 == 1).alias("allowed"))
    return feed.retry_after(calls, 60).select("endpoint", "ip", "id", "wait")


@query("SELECT l_orderkey, count(*) FILTER (WHERE q > 40 OR q < 10) AS outside, count(*) AS decided, bool_and(q BETWEEN 10 AND 40) AS all_in_range FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linenumber % 3 > 0) GROUP BY l_orderkey")
def sections_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of a section are decided and outside, and whether all are in range."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", decoders.lab_value(F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") % 3 > 0, "10 - 40").otherwise(""), F.lit("")).alias("v"))
    return overview.ranges(rows, "v", "l_orderkey")
