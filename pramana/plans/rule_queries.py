"""Rules on single texts and results, over values of the given tables.

Each query derives the inputs of a rule from columns of a table, by expressions that
Spark and DuckDB read alike, so that its rows reach the rule's branches; the SQL
computes what the rule says of them. Literal cases of the same rules are in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, languages, names, speech
from ..functions.text import bind, evidence_form
from ..operators import admission, answers, blocks, calendar, decoders, dues, evidence, guards, masking, overview, privacy, results, sharing, stores
from ..sources.tables import AMOUNT_TEXT, LETTER, WHOLE, spread, table
from .registry import query
from .text_queries import EVIDENCE

_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_YEAR, _MONTH, _DAY = f"substr({_ISO}, 1, 4)", f"substr({_ISO}, 6, 2)", f"substr({_ISO}, 9, 2)"
_DMY = f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}"
_K, _C, _CUST = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)", "CAST(c_custkey AS STRING)"
_TAMIL = "'0123456789', '௦௧௨௩௪௫௬௭௮௯'"
_PHONE = "'9' || lpad(CAST(c_custkey AS STRING), 9, '8')"
_FORM = ["rating", "lang", "docType", "sample", "appVersion", "createdAt"]
TODAY = "1995-06-17"  # within the days of the orders


def rule(name: str, source: str, key: str, fields: dict[str, str], make: Callable[..., Column], result: str) -> None:
    """Register a query: `fields` from columns of `source`, `make` of them in Spark; `result` of them in DuckDB (an expression, or a whole SELECT from `given`)."""
    given, keys = [f"{expression} AS {field}" for field, expression in fields.items()], key.split(", ")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = spread(table(spark, sf_dir, source).selectExpr(*keys, *given), keys[0])
        return asked.select(*keys, make(*(F.col(f) for f in fields)).cast("string").alias("result"))

    run.__name__, run.__doc__ = name, f"The rule of {name} over values of {source}."
    last = result if result.lstrip().startswith(("SELECT", ",")) else f"SELECT {key}, CAST({result} AS VARCHAR) AS result FROM given"
    query(f"WITH given AS (SELECT {key}, {', '.join(given)} FROM {source}) {last}")(run)


def _joined(**parts: Column) -> Column:
    return bind(lambda x: F.concat_ws("|", *(x[p].cast("string") for p in parts)), **parts)


def _today() -> Column:
    return F.lit(TODAY).cast("date")


# Admission
_ADDRESS = r"regexp_full_match(trim(t), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')"
rule(
    "email_checks", "customer", "c_custkey",
    {"t": f"CASE c_custkey % 7 WHEN 0 THEN lower(c_mktsegment) || '.' || {_CUST} || '@mail.example.com' WHEN 1 THEN ' a+' || {_CUST} || '@b.co ' WHEN 2 THEN c_name WHEN 3 THEN c_mktsegment || '@x' WHEN 4 THEN lpad({_CUST}, CAST(4 + c_custkey % 11 AS INT), '7') WHEN 5 THEN translate(lpad({_CUST}, CAST(5 + c_custkey % 5 AS INT), '8'), {_TAMIL}) END"},
    lambda t: _joined(a=admission.email_valid(t), b=admission.contact_valid(t)),
    f"CAST(coalesce({_ADDRESS}, false) AS VARCHAR) || '|' || CAST(coalesce({_ADDRESS} OR length(regexp_replace(translate(t, '௦௧௨௩௪௫௬௭௮௯', '0123456789'), '[^0-9]', '', 'g')) BETWEEN 7 AND 13, false) AS VARCHAR)",
)
rule(
    "photo_files", "part", "p_partkey",
    {"name": "p_name || CASE p_size % 8 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.jpg' WHEN 2 THEN '.pdf' WHEN 3 THEN '.heif' WHEN 4 THEN '.webp' WHEN 5 THEN '.JPEG' WHEN 6 THEN '.png.txt' ELSE '' END", "mime": "CASE p_partkey % 5 WHEN 0 THEN 'image/heif-sequence' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' WHEN 3 THEN '' END"},
    lambda n, m: _joined(a=admission.heic_file(n, m), b=admission.photo_file(n, m)),
    r"CAST(regexp_matches(lower(name), '\.(heic|heif)$') OR coalesce(mime, '') = 'image/heif-sequence' AS VARCHAR) || '|' || CAST(coalesce(mime, '') LIKE 'image/%' OR regexp_matches(lower(name), '\.(jpe?g|png|heic|webp)$') AS VARCHAR)",
)
rule(
    "sample_uploads", "part", "p_partkey", {"a": "CASE p_size % 4 WHEN 0 THEN 'sample-' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'Sample-' || p_name ELSE 'sample-x' END", "b": "CASE p_partkey % 3 WHEN 0 THEN 'sample-' || p_type WHEN 1 THEN p_type END"},
    lambda a, b: admission.sample_traffic(F.filter(F.array(a, b), lambda x: x.isNotNull())),
    "starts_with(a, 'sample-') AND (b IS NULL OR starts_with(b, 'sample-'))",
)

# Languages
_MIX = "CASE doc_id % 4 WHEN 0 THEN translate(text, 'aeiourntsl', 'अएइओउरनतसल') WHEN 1 THEN translate(text, 'eaiouy', 'அஎஇஒஉய') WHEN 2 THEN substr(text, 1, 7) ELSE text END"
_LETTERS = r"length(regexp_replace(coalesce(t, ''), '[^\p{L}]', '', 'g'))"
_LETTERS_OF = r"length(regexp_replace(regexp_replace(coalesce(t, ''), '[^\p{{L}}]', '', 'g'), '[^\x{{{}}}-\x{{{}}}]', '', 'g'))"
_INDIC, _HINDI, _TAMILS = _LETTERS_OF.format("0900", "0D7F"), _LETTERS_OF.format("0900", "097F"), _LETTERS_OF.format("0B80", "0BFF")
rule("english_readings", "documents", "doc_id", {"t": _MIX}, languages.not_english, f"CASE WHEN {_LETTERS} < 8 THEN false ELSE {_INDIC} / {_LETTERS} > 0.2 END")
rule(
    "wrong_language", "documents", "doc_id",
    {"t": _MIX, "written": "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'ta' END", "target": "CASE doc_id % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'hi-IN' WHEN 2 THEN 'ta' WHEN 3 THEN 'auto' WHEN 4 THEN lang WHEN 5 THEN '' ELSE 'de' END"},
    languages.needs_translation,
    f""", counted AS (SELECT *, split_part(lower(target), '-', 1) AS base, {_LETTERS} AS letters, {_INDIC} AS indic, {_HINDI} AS hindi, {_TAMILS} AS tamil FROM given)
    SELECT doc_id, CAST(CASE WHEN base IN ('', 'auto') THEN false WHEN letters < 8 THEN coalesce(nullif(written, ''), base) <> base WHEN base = 'en' THEN indic / letters > 0.2
      WHEN base = 'hi' THEN hindi / letters < 0.35 WHEN base = 'ta' THEN tamil / letters < 0.35 ELSE coalesce(written, '') <> base END AS VARCHAR) AS result FROM counted""",
)
rule(
    "resolved_languages", "customer", "c_custkey", {"chosen": "CASE c_custkey % 6 WHEN 0 THEN 'ta-IN' WHEN 1 THEN 'auto' WHEN 2 THEN 'xx' WHEN 3 THEN '' WHEN 4 THEN 'EN-us' END", "a": "CASE c_nationkey % 4 WHEN 0 THEN 'fr-FR' WHEN 1 THEN '' WHEN 2 THEN 'hi' END", "b": "CASE c_nationkey % 3 WHEN 0 THEN 'kn_IN' WHEN 1 THEN 'zz' END"},
    lambda c, a, b: languages.resolved_language(c, F.array(a, b)),
    "CASE WHEN chosen = 'ta-IN' THEN 'ta' WHEN chosen = 'EN-us' THEN 'en' WHEN a = 'hi' THEN 'hi' WHEN b = 'kn_IN' THEN 'kn' ELSE 'en' END",
)
rule("spoken_dates", "orders", "o_orderkey", {"t": f"'Due ' || {_ISO} || ', not ' || {_YEAR} || '-13-' || {_DAY} || ' for ' || {_K}"}, languages.natural_dates,
     "'Due ' || strftime(CAST(substr(t, 5, 10) AS DATE), '%-d %B %Y') || substr(t, 15)")
_HINDI_MONTHS = "['" + "', '".join(languages.SPOKEN_MONTHS["hi"]) + "']"
rule("spoken_dates_in_hindi", "orders", "o_orderkey", {"t": f"{_ISO} || ' तक ' || {_K}"}, lambda t: languages.natural_dates(t, "hi-IN"),
     f"CAST(CAST(substr(t, 9, 2) AS INTEGER) AS VARCHAR) || ' ' || {_HINDI_MONTHS}[CAST(substr(t, 6, 2) AS INTEGER)] || ' ' || substr(t, 1, 4) || substr(t, 11)")
# Whole numbers of up to seven digits, grouped as 12,34,567.
_GROUPS = "CASE WHEN length({0}) > 5 THEN substr({0}, 1, length({0}) - 5) || ',' || substr({0}, length({0}) - 4, 2) || ',' || right({0}, 3) WHEN length({0}) > 3 THEN substr({0}, 1, length({0}) - 3) || ',' || right({0}, 3) ELSE {0} END"
rule("amounts_in_text", "orders", "o_orderkey", {"w": WHOLE, "t": f"CASE o_orderkey % 3 WHEN 0 THEN 'Pay Rs. ' || {WHOLE} || '.50 by ' || {_YEAR} WHEN 1 THEN 'INR ' || {WHOLE} || ' or ' || {WHOLE} ELSE 'no money ' || {WHOLE} END"}, lambda w, t: languages.amounts_in_text(t),
     f"CASE o_orderkey % 3 WHEN 0 THEN 'Pay ₹' || {_GROUPS.format('w')} || substr(t, 9 + length(w)) WHEN 1 THEN '₹' || {_GROUPS.format('w')} || ' or ' || w ELSE t END")
rule("amount_values", "orders", "o_orderkey", {"w": WHOLE, "t": f"CASE o_orderkey % 5 WHEN 0 THEN 'Rs. ' || {WHOLE} WHEN 1 THEN {WHOLE} || '.5' WHEN 2 THEN {AMOUNT_TEXT} WHEN 3 THEN '' END"}, lambda w, t: languages.amount_value(F.when(t.rlike("[०-९]"), None).otherwise(t)),
     f"CASE o_orderkey % 5 WHEN 0 THEN '₹' || {_GROUPS.format('w')} WHEN 1 THEN '₹' || {_GROUPS.format('w')} || '.5' WHEN 2 THEN CASE o_orderkey % 4 WHEN 3 THEN '' ELSE '₹' || {_GROUPS.format('w')} || CASE WHEN o_orderkey % 4 = 1 THEN '.00' ELSE '' END END ELSE '' END")
rule("speaking_limits", "documents", "doc_id", {"t": "coalesce(text, '')"}, lambda t: F.concat_ws("|", languages.speak_timeout(t).cast("string"), languages.token_cap(F.length(t)).cast("string")),
     "SELECT doc_id, CAST(CASE WHEN n >= 900 THEN 25000 WHEN n <= 80 THEN 8000 ELSE CAST(floor(8000 + (n - 80) / 820 * 17000 + 0.5) AS INTEGER) END AS VARCHAR) || '|' || CAST(least(8192, greatest(1024, 400 + 120 * n)) AS VARCHAR) AS result FROM (SELECT doc_id, length(t) AS n FROM given)")

# Dates
_N, _M = "1 + o_custkey % 60", "1 + o_orderkey % 9"
_QUOTE = f"CASE o_orderkey % 6 WHEN 0 THEN 'within ' || CAST({_N} AS STRING) || ' hours' WHEN 1 THEN 'within ' || CAST({_N} AS STRING) || ' days' WHEN 2 THEN 'within the hour' WHEN 3 THEN 'pay on 10 October 2026' WHEN 4 THEN '' ELSE 'within ' || CAST({_N} AS STRING) || ' weeks' END"
_TEXT = f"CASE o_custkey % 4 WHEN 0 THEN 'Reply within ' || CAST({_M} AS STRING) || ' days' WHEN 1 THEN '' WHEN 2 THEN 'other words' ELSE 'within ' || CAST({_M} AS STRING) || ' months' END"
_ANCHOR = f"CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE {_ISO} END"
# What the rule says of these quotes and texts, step by step; every counted one is an English sentence with a word for within.
_DEADLINE = """, spans AS (
  SELECT *, CAST(anchor AS DATE) AS day, TRY_CAST(regexp_extract(quote, 'within (\\d+)', 1) AS INTEGER) AS qn, regexp_extract(quote, 'within \\d+ (hour|day|week|month)', 1) AS qu,
    TRY_CAST(regexp_extract(text, 'within (\\d+)', 1) AS INTEGER) AS tn, regexp_extract(text, 'within \\d+ (hour|day|week|month)', 1) AS tu FROM given
), dues AS (
  SELECT *, CAST(CASE qu WHEN 'hour' THEN day + CAST(ceil(qn / 24) AS INTEGER) WHEN 'week' THEN day + 7 * qn WHEN 'day' THEN day + qn END AS DATE) AS dq,
    CAST(CASE tu WHEN 'month' THEN day + to_months(tn) WHEN 'day' THEN day + tn END AS DATE) AS dt FROM spans
), asked AS (
  SELECT *, text <> '' AND quote <> '' AND tn IS NOT NULL AND qn IS NULL AS text_first, text <> '' AND ((tn IS NOT NULL AND qn IS NULL) OR quote = '' OR contains(quote, 'within')) AS use_text FROM dues
), decided AS (
  SELECT *, CASE WHEN text_first THEN coalesce(CASE WHEN use_text THEN dt END, dq) ELSE coalesce(dq, CASE WHEN use_text THEN dt END) END AS due,
    (qn IS NOT NULL OR quote = 'within the hour') OR (use_text AND tn IS NOT NULL) AS saw FROM asked
), verdicts AS (SELECT *, CASE WHEN due IS NOT NULL THEN 'computed' WHEN saw THEN 'drop' ELSE 'skip' END AS verdict, due - day AS days FROM decided)"""
rule("resolved_deadlines", "orders", "o_orderkey", {"quote": _QUOTE, "text": _TEXT, "anchor": _ANCHOR},
     lambda q, t, a: bind(lambda x: F.concat_ws(" ", x["r"]["verdict"], x["r"]["due"].cast("string"), x["r"]["days"].cast("string")), r=dates.resolved_deadline(q, t, a)),
     _DEADLINE + " SELECT o_orderkey, concat_ws(' ', verdict, CAST(due AS VARCHAR), CAST(days AS VARCHAR)) AS result FROM verdicts")
rule(
    "action_days", "orders", "o_orderkey",
    {"quote": _QUOTE, "text": _TEXT, "anchor": _ANCHOR, "rec": "CASE WHEN o_orderkey % 13 = 0 THEN 'every month' END", "n": "CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 50 AS INT) END", "counts_from": "CASE o_orderkey % 5 WHEN 0 THEN 'letter_date' WHEN 1 THEN 'receipt' END", "printed": f"CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE {_ISO} END"},
    lambda q, t, a, r, n, c, p: bind(lambda x: F.concat_ws(" ", x["d"]["due"], x["d"]["status"], x["d"]["days"].cast("string")), d=dates.action_day(r, q, t, n, c, p, a, _today())),
    _DEADLINE + f""" SELECT o_orderkey, CASE WHEN rec IS NOT NULL THEN concat_ws(' ', 'recurring', CAST(n AS VARCHAR)) WHEN verdict = 'computed' THEN concat_ws(' ', CAST(due AS VARCHAR), 'calculated', CAST(days AS VARCHAR)) WHEN verdict = 'drop' THEN 'none'
      WHEN coalesce(counts_from, 'letter_date') = 'letter_date' AND day + n IS NOT NULL THEN concat_ws(' ', CAST(CAST(day + n AS DATE) AS VARCHAR), 'calculated', CAST(n AS VARCHAR))
      ELSE concat_ws(' ', printed, CASE WHEN TRY_CAST(printed AS DATE) IS NULL THEN 'none' WHEN CAST(printed AS DATE) < DATE '{TODAY}' THEN 'passed' ELSE 'upcoming' END, CAST(n AS VARCHAR)) END AS result FROM verdicts""",
)
rule("letter_dates", "orders", "o_orderkey", {"given_day": f"CASE o_orderkey % 5 WHEN 0 THEN {_ISO} WHEN 1 THEN 'sometime' WHEN 2 THEN '' WHEN 3 THEN {_DMY} END", "pages": f"CASE o_custkey % 3 WHEN 0 THEN 'To you. Date: ' || {_DMY} || ' Re ' || {_K} WHEN 1 THEN 'DATE:  31.02.' || {_YEAR} ELSE 'no day' END"}, dates.letter_date,
     r"CASE WHEN o_orderkey % 5 = 0 THEN given_day WHEN o_orderkey % 5 = 1 THEN given_day WHEN o_orderkey % 5 = 3 THEN strftime(strptime(given_day, '%d/%m/%Y'), '%Y-%m-%d') WHEN contains(pages, 'To you') THEN strftime(strptime(regexp_extract(pages, 'Date: (\S+)', 1), '%d/%m/%Y'), '%Y-%m-%d') END")
rule(
    "passed_days", "orders", "o_orderkey", {"t": f"CASE o_orderkey % 7 WHEN 0 THEN {_ISO} WHEN 1 THEN {_ISO} || 'T10:00' WHEN 2 THEN {_DMY} WHEN 3 THEN '31/02/' || {_YEAR} WHEN 4 THEN 'soon' WHEN 5 THEN {_YEAR} || '-13-01' END"},
    lambda t: dates.is_passed(t, _today()),
    f"coalesce(CASE o_orderkey % 7 WHEN 2 THEN strptime(t, '%d/%m/%Y') WHEN 3 THEN make_date(CAST(right(t, 4) AS INTEGER), 2, 1) + 30 WHEN 4 THEN NULL WHEN 5 THEN make_date(CAST(left(t, 4) AS INTEGER) + 1, 1, 1) ELSE TRY_CAST(left(t, 10) AS DATE) END < DATE '{TODAY}', false)",
)
rule("calculated_chips", "orders", "o_orderkey", {"due": f"CASE o_orderkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN '' WHEN 2 THEN 'mid-November' ELSE {_DMY} END", "n": "CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 40 AS INT) END"}, dates.calculated_chip,
     "concat_ws(' ', CASE WHEN due = '' THEN 'Calculated' ELSE 'Calculated: ' || coalesce(strftime(TRY_CAST(due AS DATE), '%-d %b %Y'), strftime(try_strptime(due, '%d/%m/%Y'), '%-d %b %Y'), due) END, CASE WHEN n > 0 THEN '(' || n || ' days from the letter date)' END)")
rule(
    "birth_date_keys", "orders", "o_orderkey", {"day": _ISO, "t": f"CASE o_orderkey % 5 WHEN 0 THEN 'DOB: ' || {_DMY} WHEN 1 THEN 'paid on ' || {_DMY} WHEN 2 THEN 'जन्म तिथि: ' || translate({_DMY}, '0123456789', '०१२३४५६७८९') WHEN 3 THEN 'born on ' || {_ISO} || ' and dob 14/05/49' END"},
    lambda d, t: masking.birth_keys(F.array(t)),
    "CASE o_orderkey % 5 WHEN 0 THEN '[' || replace(day, '-', '') || ']' WHEN 2 THEN '[' || replace(day, '-', '') || ']' WHEN 3 THEN '[' || replace(day, '-', '') || ', 20490514]' ELSE '[]' END",
)

# Guards and answers
_RUNS = r"regexp_extract_all({0}, '\d+')"
rule(
    "number_guard", "orders", "o_orderkey",
    {"a": f"CASE WHEN o_custkey % 10 = 0 THEN 'no digits' ELSE 'Pay Rs. ' || {WHOLE} || ' for ' || {_C} END", "b": f"CASE o_orderkey % 8 WHEN 0 THEN '₹ ' || translate({WHOLE}, {_TAMIL}) || ' க்கு ' || {_C} WHEN 1 THEN 'Rs. ' || {WHOLE} || ' for ' || CAST(o_custkey + 1 AS STRING) WHEN 2 THEN {WHOLE} || ' for ' || {_C} WHEN 3 THEN '' WHEN 4 THEN 'INR 9' || {WHOLE} || '9 ' || {_C} WHEN 5 THEN 'Rs. ' || {_C} || ' of ' || {WHOLE} WHEN 6 THEN '₹ ' || {WHOLE} END"},
    guards.translation_keeps_numbers,
    f"""SELECT o_orderkey, CAST(CASE WHEN len(ra) = 0 THEN true WHEN fb = '' THEN false ELSE len(list_filter(ra, lambda d: len(list_filter(rb, lambda o: contains(o, d))) = 0)) = 0 AND (NOT contains(a, 'Rs.') OR regexp_matches(fb, 'Rs\\.|INR|₹')) END AS VARCHAR) AS result
      FROM (SELECT *, {_RUNS.format('a')} AS ra, {_RUNS.format('fb')} AS rb FROM (SELECT *, translate(coalesce(b, ''), '௦௧௨௩௪௫௬௭௮௯', '0123456789') AS fb FROM given))""",
)
rule(
    "protected_term_guard", "part", "p_partkey",
    {"a": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE 'Claim of ' || p_name || ' by  ' || p_brand END", "b": "CASE p_size % 6 WHEN 0 THEN upper(p_name) || ' ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN 'nothing' WHEN 3 THEN '' WHEN 4 THEN p_brand || '  ' || p_name || ' more' END", "one": "p_name", "two": "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Claims Department' ELSE p_type END"},
    lambda a, b, one, two: guards.translation_keeps_terms(a, b, F.array(one, two)),
    "CASE WHEN coalesce(a, '') = '' THEN true WHEN coalesce(b, '') = '' THEN false ELSE contains(lower(b), lower(one)) AND (two = 'Claims Department' OR NOT contains(lower(a), lower(two)) OR contains(lower(b), lower(two))) END",
)
rule("kept_labels", "part", "p_partkey", {"a": "p_brand", "b": "CASE p_size % 5 WHEN 0 THEN 'ब्रांड ' || p_brand WHEN 1 THEN 'ब्रांड' WHEN 2 THEN '' WHEN 3 THEN 'x' || substr(p_brand, 7) END"}, guards.kept_label,
     "CASE WHEN coalesce(b, '') = '' OR NOT contains(b, substr(a, 7)) THEN a ELSE b END")
_SAID = f"CASE o_orderkey % 4 WHEN 0 THEN 'It is ' || {WHOLE} WHEN 1 THEN 'It is ' || {WHOLE} || '7' WHEN 2 THEN 'nothing' ELSE 'It is 0' || {_C} END"
_FACT = f"CASE o_custkey % 4 WHEN 0 THEN {WHOLE} WHEN 1 THEN '99887766' WHEN 2 THEN 'none' ELSE ' ' END"
rule(
    "guarded_answers", "orders", "o_orderkey", {"letter": f"'Rs. ' || {WHOLE} || ' by ' || {_C}", "said": _SAID, "fact": _FACT, "general": "CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END", "own": _C},
    lambda l, s, f, g, o: bind(lambda x: F.concat_ws("|", F.array_join(F.transform(x["r"]["facts"], lambda y: F.concat_ws("=", y["label"], y["value"])), ","), x["r"]["invented"].cast("string")), r=answers.guarded_numbers(s, F.array(F.struct(F.lit("a").alias("label"), f.alias("value")), F.struct(F.lit("b").alias("label"), o.alias("value"))), l, g)),
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN trim(fact) <> '' AND NOT (fact <> 'none' AND is_general) AND fact <> '99887766' THEN 'a=' || fact END, CASE WHEN NOT is_general THEN 'b=' || own END) || '|' ||
      CAST(len(list_filter({_RUNS.format('said')}, lambda d: NOT list_contains(known, d) AND NOT list_contains(known, coalesce(nullif(ltrim(d, '0'), ''), '0')))) > 0 OR (fact = '99887766' AND NOT is_general) AS VARCHAR) AS result FROM (SELECT *, {_RUNS.format('letter')} AS known, coalesce(general, false) AS is_general FROM given)""",
)
rule(
    "answer_sources", "orders", "o_orderkey",
    {"said": "CASE o_orderkey % 4 WHEN 0 THEN ' General ' WHEN 1 THEN 'document' WHEN 2 THEN 'summary' END", "gone": "o_custkey % 5 = 0", "quote": "CASE o_custkey % 3 WHEN 0 THEN 'q' WHEN 1 THEN '' END", "files": "o_custkey % 7 < 3", "pages": "o_orderkey % 11 < 6", "invented": "CASE WHEN o_orderkey % 13 < 2 THEN true WHEN o_orderkey % 13 < 9 THEN false END"},
    lambda a, n, q, f, p, i: bind(lambda x: F.concat_ws("|", x["r"]["answered_from"], x["r"]["evidence"]), r=answers.answer_evidence(a, n, q, F.lit("matched"), f, p, i)),
    """SELECT o_orderkey, CASE WHEN lower(trim(coalesce(said, ''))) = 'general' THEN 'general|none' ELSE CASE WHEN NOT gone AND coalesce(quote, '') <> '' AND pages THEN 'document' WHEN files OR pages THEN 'document' ELSE 'summary' END || '|' ||
      CASE WHEN coalesce(invented, false) THEN 'check_original' WHEN gone THEN 'none' WHEN coalesce(quote, '') <> '' AND pages THEN 'matched' WHEN files OR pages THEN 'check_original' ELSE 'none' END END AS result FROM given""",
)
rule(
    "keyed_payloads", "part", "p_partkey",
    {"k": "p_size % 4", "name": "p_name", "kind": "p_type", "raw": """CASE p_size % 4 WHEN 0 THEN '{"strings": {"a": "' || p_name || '", "n": 5}, "b": "y"}' WHEN 1 THEN '{"a": "' || p_type || '", "l": ["q"], "strings": {"n": 1}}' WHEN 2 THEN p_name END"""},
    lambda k, n, t, r: F.array_join(F.transform(F.map_entries(answers.keyed_payload(r)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","),
    "CASE k WHEN 0 THEN 'a=' || name WHEN 1 THEN 'a=' || kind ELSE '' END",
)
rule("short_lists", "part", "p_partkey", {"a": "p_name", "b": "CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type END", "c": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END"}, lambda a, b, c: F.array_join(answers.short_list(F.array(a, b, c, F.concat(F.lit(" x  "), a), F.lit("y"), F.lit("z")), 4), "|"),
     "array_to_string(list_slice(list_filter([a, nullif(trim(b), ''), c, 'x ' || a, 'y', 'z'], lambda v: v IS NOT NULL), 1, 4), '|')")

# Evidence
rule(
    "place_evidence", "orders", "o_orderkey", {"t": LETTER, "address": f"CASE o_orderkey % 4 WHEN 0 THEN 'claim clm-' || {_K} WHEN 1 THEN '13 main road' WHEN 2 THEN '' END", "said": f"CASE o_custkey % 3 WHEN 0 THEN 'main road' WHEN 1 THEN '₹' || {WHOLE} ELSE '' END"},
    lambda t, a, q: bind(lambda x: evidence.place(a, q, x["form"]), form=evidence_form(t)),
    f"CASE WHEN coalesce(address <> '' AND contains({EVIDENCE}, address), false) OR (said <> '' AND contains({EVIDENCE}, said)) THEN 'matched' ELSE 'check_original' END",
)
# A value by its form in the text, an amount also by the digits of the letter's own amount.
rule(
    "glance_evidence", "orders", "o_orderkey",
    {"t": LETTER, "w": WHOLE, "kind": "CASE o_custkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'date' ELSE 'text' END", "v": f"CASE o_orderkey % 8 WHEN 0 THEN 'Rs. ' || {WHOLE} WHEN 1 THEN 'about INR ' || {WHOLE} || '.00' WHEN 2 THEN {WHOLE} || '1' WHEN 3 THEN {_DAY} || '.' || {_MONTH} || '.' || {_YEAR} WHEN 4 THEN {_DAY} || ' of ' || {_YEAR} WHEN 5 THEN 'only ' || {WHOLE} || ' rupees' WHEN 6 THEN '' END"},
    lambda t, w, k, v: evidence.glance(v, k, t),
    f"""SELECT o_orderkey, CASE WHEN (form <> '' AND contains(text_form, form)) OR (kind = 'amount' AND digits <> '' AND digits = CASE WHEN o_orderkey % 4 = 1 THEN w || '00' ELSE w END) THEN 'matched' ELSE 'check_original' END AS result
      FROM (SELECT *, regexp_replace(coalesce(v, ''), '[^0-9]', '', 'g') AS digits, {EVIDENCE} AS form FROM (SELECT * EXCLUDE (t), {EVIDENCE} AS text_form, coalesce(v, '') AS t FROM given))""",
)
rule("part_glance_evidence", "orders", "o_orderkey", {"t": LETTER, "v": f"CASE o_orderkey % 3 WHEN 0 THEN {AMOUNT_TEXT} WHEN 1 THEN lower({AMOUNT_TEXT}) END"}, lambda t, v: evidence.part_glance(v, t), "CASE WHEN v IS NOT NULL AND contains(t, v) THEN 'matched' ELSE 'check_original' END")

# Masking and sharing
_STARS = "substr(c_name, 1, 1) || repeat('*', length(c_name) - 1)"
rule("outside_spans", "customer", "c_custkey", {"name": "c_name", "phone": _PHONE, "stars": _STARS, "t": f"CASE c_custkey % 3 WHEN 0 THEN c_name || ' called ' || {_PHONE} || ' twice, ' || c_name WHEN 1 THEN 'from Main Road, not ' || lower(c_name) ELSE '' END"},
     lambda n, p, s, t: sharing.with_spans_masked(t, F.array(*(F.struct(c.alias("text"), F.lit(k).alias("type")) for c, k in [(F.right(n, F.lit(4)), "id"), (n, "person"), (p, "phone"), (F.lit("Main Road"), "address"), (F.lit("called"), "verb")])), F.lit("en")),
     "CASE c_custkey % 3 WHEN 0 THEN stars || ' called ********** twice, ' || stars WHEN 1 THEN 'from [hidden], not ' || regexp_replace(lower(name), '.{4}$', '') || '*' || right(name, 3) ELSE '' END")
_BORN = f"strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER), '%d/%m/%Y')"
_BORN_SPARK = "date_format(date_add(DATE '1950-01-01', CAST(c_custkey % 15000 AS INT)), 'dd/MM/yyyy')"


@query(
    f"""WITH given AS (SELECT c_custkey, {_BORN} AS born, {_STARS} AS stars, c_custkey % 3 = 0 AS closed FROM customer)
SELECT c_custkey, CASE WHEN closed THEN 'Some details were removed to protect privacy.||' ELSE 'bill; born [hidden]||on [hidden] and ' || CASE WHEN born = '15/05/1980' THEN '[hidden]' ELSE '15/05/1980' END END || '|' || 'Pay Rs. 500 to ' || stars || '|' ||
  CASE WHEN closed THEN born || ',Rs. 500,' || replace(born, '/', '.') || CASE WHEN born = '15/05/1980' THEN '' ELSE ',15/05/1980' END ELSE '' END AS result FROM given"""
)
def redacted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a birth date that other lines repeat, and a customer's name; every third without its names told apart."""
    rows = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_BORN_SPARK} AS born", "c_name", "c_custkey % 3 = 0 AS closed"), "c_custkey")
    summary, action = F.concat(F.lit("bill; born "), "born"), F.concat(F.lit("Pay Rs. 500 to "), "c_name")
    fact = F.concat(F.lit("on "), F.replace(F.col("born"), F.lit("/"), F.lit(".")), F.lit(" and 15/05/1980"))
    made = sharing.redacted(F.array(summary), F.array(action), F.array(fact), F.array("c_name"), F.col("closed"), F.lit("en"))
    shown = bind(lambda x: F.concat_ws("|", F.array_join(x["r"]["summary"], ","), F.lit(""), F.array_join(x["r"]["facts"], ","), F.array_join(x["r"]["actions"], ","), F.array_join(x["r"]["dates_and_amounts"], ",")), r=made)
    return rows.select("c_custkey", shown.alias("result"))


rule(
    "share_texts", "part", "p_partkey", {"title": "p_name", "kind": "p_type", "brand": "p_brand", "n": "p_size % 3", "how": "CASE WHEN p_partkey % 2 = 0 THEN 'after food' END"},
    lambda t, k, b, n, h: sharing.share_text(
        t, F.struct(F.array(F.concat(F.lit("about "), k)).alias("summary"), F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(b)).otherwise(F.array(b, k)).alias("actions"), F.array(sharing.medicine_line(F.struct(t.alias("name"), F.lit("5 mg").alias("strength"), h.alias("instruction"), F.lit("OD").alias("frequency")))).alias("medicines")),
        ["summary", "actions", "medicines"], F.array(F.struct(b.alias("title"), F.array(k).alias("lines"))),
    ),
    """'📄 ' || title || chr(10) || chr(10) || '📌 In simple words:' || chr(10) || '• about ' || kind || CASE n WHEN 0 THEN '' ELSE chr(10) || chr(10) || '✅ What you need to do:' || chr(10) || '1. ' || brand || CASE n WHEN 2 THEN chr(10) || '2. ' || kind ELSE '' END END ||
      chr(10) || chr(10) || '💊 Prescribed medicines:' || chr(10) || '• ' || title || ' 5 mg' || coalesce(' — ' || how, ' (OD)') || chr(10) || chr(10) || '📑 Documents:' || chr(10) || chr(10) || '--- ' || brand || ' ---' || chr(10) || '• ' || kind || chr(10)""",
)
rule("checked_shares", "customer", "c_custkey", {"ok": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "name": "c_name", "stars": _STARS},
     lambda ok, n, s: bind(lambda x: F.concat_ws("|", x["r"]["text"], x["r"]["closed"].cast("string")), r=sharing.checked_share(ok, F.array(F.struct(n.alias("text"), F.lit("person").alias("type"))), F.concat(n, F.lit(" pays")), F.lit("closed"), F.lit("en"))),
     "CASE WHEN ok THEN stars || ' pays|false' ELSE 'closed|true' END")
rule("check_keys", "part", "p_partkey", {"id": "CASE WHEN p_size % 4 > 0 THEN p_name END", "lang": "CASE p_partkey % 3 WHEN 0 THEN 'ta' WHEN 1 THEN '' END"}, sharing.check_key, "coalesce(id, '') || '|' || coalesce(nullif(lang, ''), 'en') || '|hide'")
rule("shared_titles", "part", "p_partkey", {"title": "CASE WHEN p_size % 4 > 0 THEN p_name ELSE '' END", "hide": "p_partkey % 3 = 0"}, lambda t, h: sharing.shared_title(t, F.lit("insurance"), F.lit("en"), h), "CASE WHEN hide THEN 'Insurance letter' WHEN title = '' THEN 'Document' ELSE title END")

# Calendars
_DUE = f"CASE o_orderkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN NULL WHEN 2 THEN {_DMY} ELSE 'soon' END"
_PASSED = f"coalesce(CASE o_orderkey % 4 WHEN 0 THEN TRY_CAST(due AS DATE) WHEN 2 THEN CAST(try_strptime(due, '%d/%m/%Y') AS DATE) END < DATE '{TODAY}', false)"
_STATUS, _RECURS = "CASE o_custkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'upcoming' END", "CASE WHEN o_custkey % 3 = 0 THEN 'monthly' END"
_FITS = f"(NOT {_PASSED} AND coalesce(status, '') <> 'passed' AND (coalesce(due, '') <> '' OR coalesce(rec, '') <> ''))"
rule("calendar_eligible", "orders", "o_orderkey", {"due": _DUE, "status": _STATUS, "rec": _RECURS}, lambda d, s, r: calendar.eligible(d, s, r, _today()), _FITS)
_EVENT_TITLE = "'  Pay   order ' || CAST(o_orderkey AS STRING) || ';' || repeat(' now', CAST(o_custkey % 20 AS INT))"
_TIME, _ALERT = "CASE o_orderkey % 4 WHEN 0 THEN '09:30:00' WHEN 1 THEN '' WHEN 2 THEN '9:30' END", "CASE o_custkey % 6 WHEN 0 THEN '1d' WHEN 1 THEN '3d' WHEN 2 THEN '1w' WHEN 3 THEN '0' WHEN 4 THEN 'x' END"
_SHORT = "CASE WHEN length(plain) <= 60 THEN plain ELSE rtrim(substr(plain, 1, 59)) || '…' END"
_TRIGGER = "CASE alert WHEN '1d' THEN '-P1D' WHEN '3d' THEN '-P3D' WHEN '1w' THEN '-P1W' WHEN '0' THEN '-PT0S' ELSE 'PT9H' END"
_DRAFTED = f", drafted AS (SELECT *, {_SHORT} AS shown, coalesce(time, '') = '09:30:00' AS timed, {_TRIGGER} AS alarm FROM (SELECT *, regexp_replace(trim(title), '\\s+', ' ', 'g') AS plain FROM given))"
rule("calendar_drafts", "orders", "o_orderkey", {"title": _EVENT_TITLE, "day": _ISO, "time": _TIME, "alert": _ALERT},
     lambda t, d, h, a: bind(lambda x: F.concat_ws("|", x["e"]["title"], x["e"]["start"], x["e"]["all_day"].cast("string"), x["e"]["alarm"], x["e"]["description"]), e=calendar.draft(F.lit("u"), t, F.lit(None).cast("string"), d, h, a)),
     _DRAFTED + " SELECT o_orderkey, concat_ws('|', shown, day || CASE WHEN timed THEN 'T09:30:00' ELSE '' END, CAST(NOT timed AS VARCHAR), alarm, 'Reminder.') AS result FROM drafted")
_LINES = "chr(13) || chr(10)"
# Lines of this file are plain ASCII but for the sign of a cut title (three octets), so a line has at most 75 octets or is cut behind the 75th.
rule(
    "calendar_files", "orders", "o_orderkey", {"title": _EVENT_TITLE, "day": _ISO, "time": _TIME, "alert": _ALERT, "note": f"'see ' || repeat('page x ', CAST(o_custkey % 9 AS INT)) || {_C}", "rec": "CASE WHEN o_custkey % 4 = 0 THEN 'FREQ=MONTHLY' END"},
    lambda t, d, h, a, n, r: calendar.calendar_file(F.array(calendar.draft(F.lit("u"), t, n, d, h, a, r)), F.lit("20261006T000000Z"), "pramana", "example.org"),
    _DRAFTED + f""", lines AS (SELECT *, 'SUMMARY:' || replace(shown, ';', '\\;') AS s, 'DESCRIPTION:' || replace(shown, ';', '\\;') AS a, 'DESCRIPTION:' || regexp_replace(note, '\\s+', ' ', 'g') AS d FROM drafted),
    folded AS (SELECT *, CASE WHEN strlen(a) <= 75 THEN a WHEN strlen(substr(a, 1, 73)) = 75 OR NOT contains(a, '…') THEN substr(a, 1, 75) || {_LINES} || ' ' || substr(a, 76) ELSE rtrim(a, '…') || {_LINES} || ' …' END AS fa, CASE WHEN length(d) <= 75 THEN d ELSE substr(d, 1, 75) || {_LINES} || ' ' || substr(d, 76) END AS fd FROM lines)
    SELECT o_orderkey, array_to_string(list_filter(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//pramana//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'BEGIN:VEVENT', 'UID:u@example.org', 'DTSTAMP:20261006T000000Z',
      CASE WHEN timed THEN 'DTSTART:' || replace(day, '-', '') || 'T093000' ELSE 'DTSTART;VALUE=DATE:' || replace(day, '-', '') END, s, fd, 'RRULE:' || rec, 'BEGIN:VALARM', 'ACTION:DISPLAY', fa, 'TRIGGER:' || alarm, 'END:VALARM', 'END:VEVENT', 'END:VCALENDAR'], lambda x: x IS NOT NULL), {_LINES}) || {_LINES} AS result FROM folded""",
)
rule(
    "action_events", "orders", "o_orderkey", {"due": _DUE, "status": _STATUS, "rec": _RECURS, "name": f"'Pay ' || {_K}", "single": "o_custkey % 2 = 0"},
    lambda d, s, r, n, one: bind(
        lambda x: F.array_join(F.transform(F.when(one, x["one"]).otherwise(x["all"]), lambda e: F.concat_ws("~", e["uid"], e["title"], e["start"], F.coalesce(e["rrule"], F.lit("")))), "|"),
        **{k: calendar.action_events(F.array(F.struct(n.alias("text"), d.alias("due"), s.alias("status"), r.alias("recurrence")), F.struct(F.lit("Rent").alias("text"), F.lit(None).cast("string").alias("due"), F.lit("recurring").alias("status"), F.lit("monthly").alias("recurrence"))), n, F.lit("1d"), _today(), lambda c: c, single=v) for k, v in (("one", True), ("all", False))},
    ),
    f"""SELECT o_orderkey, concat_ws('|', CASE WHEN fits THEN name || mark || '0~' || name || '~' || left(coalesce(nullif(due, ''), '{TODAY}'), 10) || 'T09:00:00~' || CASE WHEN single AND rec IS NOT NULL THEN 'FREQ=MONTHLY' ELSE '' END END,
      name || mark || CASE WHEN fits THEN '1' ELSE '0' END || '~Rent~{TODAY}T09:00:00~' || CASE WHEN single THEN 'FREQ=MONTHLY' ELSE '' END) AS result FROM (SELECT *, {_FITS} AS fits, CASE WHEN single THEN '-act-' ELSE '-act-all-' END AS mark FROM given)""",
)
rule("dose_calendars", "part", "p_partkey", {"days": "CASE WHEN p_size % 3 > 0 THEN p_size END", "name": "p_name", "slot": "CASE WHEN p_partkey % 2 = 0 THEN 'night' ELSE 'morning' END"},
     lambda d, n, s: F.array_join(F.transform(calendar.dose_calendar(F.array(F.struct(F.lit(0).alias("medicine"), s.alias("slot"), F.lit("21:00").alias("time"))), F.array(F.struct(d.alias("duration_days"))), n, F.lit("2026-10-06"), F.lit("1d"), n), lambda e: F.concat_ws("~", e["uid"], e["title"], e["start"], F.coalesce(e["rrule"], F.lit("")))), "|"),
     "name || '-med-0-' || slot || '~' || name || '~2026-10-06T21:00:00~' || CASE WHEN days > 0 THEN 'FREQ=DAILY;COUNT=' || days ELSE '' END")
rule("dates_lists", "orders", "o_orderkey", {"name": f"'Pay ' || {_K}", "day": _ISO, "note": "CASE o_custkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN '' END"},
     lambda n, d, x: calendar.dates_text(F.array(F.struct(n.alias("title"), d.alias("start"), x.alias("description")), F.struct(F.lit("Rent").alias("title"), d.alias("start"), F.lit(None).cast("string").alias("description")))),
     "'• ' || name || ': ' || day || CASE WHEN note = 'now' THEN ' (now)' ELSE '' END || chr(10) || '• Rent: ' || day")
rule("calendar_links", "part", "p_partkey", {"name": "p_name || ' & ' || p_type", "note": "CASE WHEN p_size % 2 = 0 THEN 'by ' || p_brand ELSE '' END"},
     lambda t, n: F.concat_ws("|", calendar.calendar_link("https://calendar.example.org/render", t, F.lit("2026-10-07"), n), calendar.message_link("https://message.example.org/?text=", n)),
     "'https://calendar.example.org/render?action=TEMPLATE&text=' || replace(replace(name, ' ', '%20'), '&', '%26') || '&dates=20261007/20261007' || CASE WHEN note = '' THEN '' ELSE '&details=' || replace(replace(note, ' ', '%20'), '#', '%23') END || '|https://message.example.org/?text=' || replace(replace(note, ' ', '%20'), '#', '%23')")

# Results
rule("headlines", "documents", "doc_id", {"t": "text"}, results.headline, r"array_to_string(list_slice(string_split_regex(regexp_replace(regexp_replace(coalesce(t, ''), '^ +| +$', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), 1, 12), ' ')")
rule("asks_kept", "part", "p_partkey", {"n": "p_size"}, lambda n: bind(lambda x: F.concat(F.size(x["a"]).cast("string"), F.lit(":"), F.get(x["a"], F.lit(0)).cast("string"), F.lit(","), F.element_at(x["a"], -1).cast("string")), a=stores.asks_appended(F.sequence(F.lit(1), n), F.array(n + 1))),
     "least(n + 1, 40) || ':' || greatest(n - 38, 1) || ',' || (n + 1)")
rule("document_names", "part", "p_partkey", {"name": "CASE p_size % 4 WHEN 0 THEN ' ' || p_name || ' ' WHEN 1 THEN '' WHEN 2 THEN repeat(p_name, 8) END", "title": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' ' || p_type || ' ' END"}, lambda n, t: F.concat_ws("|", results.renamed(n, t), results.visible_title(n, t)),
     "CASE WHEN trim(coalesce(name, '')) <> '' THEN left(trim(name), 60) || '|' || left(trim(name), 60) ELSE trim(coalesce(title, '')) || '|' || coalesce(title, '') END")
rule(
    "due_days", "orders", "o_orderkey", {"printed": f"CASE o_orderkey % 3 WHEN 0 THEN {_ISO} WHEN 1 THEN '' END", "emi": f"CASE o_custkey % 3 WHEN 0 THEN {_DMY} WHEN 1 THEN '' END", "status": "CASE WHEN o_orderkey % 2 = 0 THEN 'upcoming' ELSE 'passed' END", "day": _ISO},
    lambda p, e, s, d: dues.due_day(p, e, F.array(F.struct(F.lit(None).cast("string").alias("due"), F.lit("none").alias("status")), F.struct(d.alias("due"), s.alias("status")))),
    "coalesce(nullif(printed, ''), nullif(emi, ''), CASE WHEN status = 'upcoming' THEN day END, '')",
)
rule("feedback_reasons", "events", "event_id", {"rating": "CASE WHEN event_id % 3 = 0 THEN 'up' ELSE 'down' END", "a": "CASE WHEN event_id % 2 = 0 THEN 'other' END", "b": "CASE WHEN user_id % 2 = 0 THEN 'wrong_date' ELSE 'other' END"}, lambda r, a, b: results.feedback_reasons(r, F.filter(F.array(b, a, b), lambda x: x.isNotNull())),
     "CASE WHEN rating = 'down' THEN '[' || CASE WHEN a IS NULL OR a = b THEN b ELSE b || ', ' || a END || ']' END")
rule("translations_put", "part", "p_partkey", {"lang": "CASE p_size % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'ta' ELSE 'a' END", "name": "p_name"}, lambda l, n: F.array_join(F.transform(F.array_sort(F.map_entries(stores.translation_put(F.create_map(F.lit("hi"), F.lit("old")), l, n))), lambda e: F.concat_ws("=", e["key"], e["value"])), ","),
     "CASE lang WHEN 'hi' THEN 'hi=' || name WHEN 'ta' THEN 'hi=old,ta=' || name ELSE 'a=' || name || ',hi=old' END")

# Names and speech
_SEGMENT = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
rule(
    "role_names", "customer", "c_custkey",
    {"t": f"CASE c_custkey % 10 WHEN 0 THEN 'Patient Ravi ' || {_SEGMENT} || ' shall pay' WHEN 1 THEN 'Registered Owner: Smt. Lakshmi ' || substr('ABCDEFGHIJ', CAST(c_nationkey % 10 + 1 AS INT), 1) || 'devi is here' WHEN 2 THEN 'the patient is fine' WHEN 3 THEN c_name WHEN 5 THEN 'Patient Ravi Kumar ' || {_SEGMENT} || ' Gupta' WHEN 6 THEN 'शिकायतकर्ता रवि ने कहा ' || c_name WHEN 7 THEN 'Respondent The ' || {_SEGMENT} WHEN 8 THEN 'Owner Notice ' || {_SEGMENT} WHEN 9 THEN 'Registered Owner: Smt. Lakshmi Devi shall pay ' || c_name END", "seg": _SEGMENT},
    lambda t, s: F.array_join(names.after_roles(t), ","),
    "CASE c_custkey % 10 WHEN 0 THEN 'Ravi ' || seg WHEN 1 THEN regexp_extract(t, '(Lakshmi \\w+)', 1) WHEN 5 THEN 'Ravi Kumar ' || seg WHEN 6 THEN 'रवि' WHEN 9 THEN 'Lakshmi Devi' ELSE '' END",
)
rule("spoken_capitals", "part", "p_partkey", {"t": "'PAY ' || upper(p_name) || ' for ' || p_brand || ' GST AB' || CAST(p_partkey AS STRING)", "name": "p_name", "brand": "p_brand"}, lambda t, n, b: languages.spoken_capitals(t),
     "'Pay ' || array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN length(w) < 3 THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') || ' for ' || brand || ' GST AB ' || p_partkey")
rule("spoken_texts", "orders", "o_orderkey", {"w": WHOLE, "day": _ISO, "t": f"'Dr. Rao paid Rs. ' || {WHOLE} || ' on ' || {_DAY} || '.' || {_MONTH} || '.' || {_YEAR} || ' and owes ' || {_C} || ' INR by ' || {_ISO}", "c": _C}, lambda w, d, t, c: speech.spoken(t),
     "'Doctor Rao paid ' || w || ' rupees on ' || strftime(CAST(day AS DATE), '%-d %B %Y') || ' and owes ' || c || ' rupees by ' || strftime(CAST(day AS DATE), '%-d %B %Y')")
rule(
    "client_personal_fields", "customer", "c_custkey", {"t": f"CASE c_custkey % 9 WHEN 0 THEN 'Folio ' || {_CUST} WHEN 1 THEN 'Total amount: Rs. ' || {_CUST} WHEN 2 THEN 'call ' || {_PHONE} WHEN 3 THEN '45 Y / M' WHEN 4 THEN lower(c_mktsegment) WHEN 5 THEN 'mail a@' || lower(c_mktsegment) || '.org' WHEN 6 THEN '' WHEN 7 THEN 'Pension amount: Rs. ' || {_CUST} END", "marked": "CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"},
    lambda t, m: privacy.personal_field(t, F.lit(None).cast("string"), m, privacy.CLIENT_RULES),
    "coalesce(marked, false) OR (t IS NOT NULL AND c_custkey % 9 IN (0, 2, 3, 5)) OR (c_custkey % 9 IN (1, 7) AND regexp_matches(t, '\\d{8,}'))",
)

rule(
    "glance_value_lists", "orders", "o_orderkey", {"t": f"'Rs. ' || {WHOLE} || ' for ' || {_C}", "w": WHOLE, "c": _C, "n": "CAST(o_orderkey % 9 AS INT)"},
    lambda t, w, c, n: F.array_join(F.transform(results.glance_values(F.slice(F.array(*(F.struct(F.lit(f"v{i}").alias("label"), v.alias("value"), F.lit(k).alias("kind")) for i, (v, k) in enumerate([(w, "amount"), (c, "other"), (F.concat(w, F.lit("9")), "amount"), (F.lit("none"), "text"), (c, "text"), (w, "date"), (c, "amount"), (w, "text")]))), 1, n), t), lambda v: F.concat_ws("=", v["label"], v["kind"], v["evidence"])), "|"),
    "array_to_string(list_slice(['v0=amount=matched', 'v1=text=matched', 'v2=amount=check_original', 'v3=text=check_original', 'v4=text=matched', 'v5=date=matched'], 1, least(n, 6)), '|')",
)
rule("names_to_ask", "part", "p_partkey", {"n": "p_size % 20", "name": "p_name"}, lambda n, name: results.names_to_ask(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(name, F.lit(" "), i.cast("string")))),
     "array_to_string(list_transform(range(1, least(n + 1, 12) + 1), lambda i: '- ' || name || ' ' || i), chr(10))")
rule(
    "ask_contexts", "part", "p_partkey", {"name": "p_name", "kind": "p_type", "k": "p_size % 6", "raw": """CASE p_size % 6 WHEN 0 THEN '{"title":"' || p_name || '","source_text":"secret","document_kind":"' || p_type || '","parts":[{"source_text":"s","title":"é"},7]}' WHEN 1 THEN '{"doc_type": "' || p_type || '", "n": 1.50, "protected_terms_rendered": {"a": []}}' WHEN 2 THEN p_name WHEN 3 THEN '["' || p_name || '"]' WHEN 4 THEN '' END"""},
    lambda n, t, k, r: _joined(k=answers.ask_context(r)["kind"], c=answers.ask_context(r)["context"]),
    """CASE k WHEN 0 THEN kind || '|{"title": "' || name || '", "document_kind": "' || kind || '", "parts": [{"title": "é"}, 7]}' WHEN 1 THEN kind || '|{"doc_type": "' || kind || '", "n": 1.5}' WHEN 2 THEN '|' || name WHEN 3 THEN '|["' || name || '"]' ELSE '|{}' END""",
)

# Uploads, threads, questions, names, spoken texts and kinds
rule("photo_uploads", "part", "p_partkey", {"a": "p_name || CASE p_size % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.pdf' END", "mime": "CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN '' END", "none": "p_size % 7 = 0"},
     lambda a, m, none: admission.photo_upload(F.when(~none, F.array(F.struct(a.alias("name"), F.lit("").alias("mime")), F.struct(F.lit("b").alias("name"), m.alias("mime"))))),
     r"NOT none AND regexp_matches(lower(a), '\.(jpe?g|png|heic|webp)$') AND coalesce(mime, '') LIKE 'image/%'")
rule("thread_turns", "conversations", "conv_id, turn", {"doc": "CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 7 > 0 THEN 'd' || CAST(conv_id AS STRING) END", "owner": "'d' || CAST(conv_id - conv_id % 2 AS STRING)", "saved": "CASE WHEN turn % 3 > 0 THEN role END", "live": "CASE WHEN turn % 2 = 0 THEN text END"},
     lambda d, o, s, l: F.array_join(admission.asks_of_document(d, F.filter(F.array(s), lambda x: x.isNotNull()), o, F.filter(F.array(l), lambda x: x.isNotNull())), ","),
     "CASE WHEN coalesce(doc, '') = '' THEN '' WHEN owner = doc AND live IS NOT NULL THEN live ELSE coalesce(saved, '') END")
_QUESTION = "CASE conv_id % 4 WHEN 0 THEN 'Why ' || text WHEN 1 THEN text || ' यह क्यों है' WHEN 2 THEN text || ' usually?' ELSE text END"
rule("question_settings", "conversations", "conv_id, turn", {"q": _QUESTION}, lambda q: bind(lambda x: F.concat_ws("|", x["s"]["temperature"].cast("string"), x["s"]["thinking"].cast("string")), s=languages.ask_settings(q)),
     r"CASE WHEN regexp_matches(coalesce(q, ''), '(?i)\b(why|what does|what do|mean|means|generally|usually)\b|क्यों') THEN '0.3|512' ELSE '0.0|0' END")


def _words(words: dict[str, str], lang: str = "lang") -> str:
    """A word in a language in DuckDB."""
    cases_ = " ".join(f"WHEN '{code}' THEN '{word}'" for code, word in words.items())
    return f"CASE split_part(lower(coalesce(nullif({lang}, ''), 'en')), '-', 1) {cases_} ELSE '{words['en']}' END"


_LANG = "CASE p_size % 6 WHEN 0 THEN 'ta-IN' WHEN 1 THEN 'hi' WHEN 2 THEN 'en-IN' WHEN 3 THEN 'xx' WHEN 4 THEN 'te' END"
_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'insurance' WHEN 1 THEN 'lab_report' WHEN 2 THEN 'challan' WHEN 3 THEN 'loan' WHEN 4 THEN 'school' END"
rule("closing_notes", "part", "p_partkey", {"q": "CASE WHEN p_size % 5 = 0 THEN 'Is my sugar fine?' ELSE 'When is ' || p_name || ' due?' END", "kind": _KIND, "lang": _LANG}, languages.closing_note,
     f"CASE WHEN coalesce(kind, '') = 'lab_report' OR contains(q, 'sugar') THEN {_words(languages.DOCTOR_NOTE)} WHEN kind = 'challan' THEN {_words(languages.LEGAL_NOTE)} WHEN kind IN ('insurance', 'loan') THEN {_words(languages.MONEY_NOTE)} ELSE '' END")
_TITLES = {k: languages.DOCUMENT_TITLES.get(k, languages.DOCUMENT_TITLES["other"]) for k in ("insurance", "lab_report", "challan", "loan", "school", "other")}
rule("localised_words", "part", "p_partkey", {"kind": _KIND, "lang": _LANG}, lambda k, l: F.concat_ws("|", languages.by_language(languages.HIDDEN, l), languages.document_title(k, l), languages.by_language(languages.REMOVED, l)),
     f"concat_ws('|', {_words(languages.HIDDEN)}, CASE coalesce(kind, 'other') {' '.join(f'''WHEN '{k}' THEN {_words(w)}''' for k, w in _TITLES.items())} END, {_words(languages.REMOVED)})")
rule("person_terms", "customer", "c_custkey", {"t": f"CASE c_custkey % 8 WHEN 0 THEN 'Mr. ' || {_SEGMENT} WHEN 1 THEN 'Asha ' || {_SEGMENT} WHEN 2 THEN {_SEGMENT} WHEN 3 THEN c_name WHEN 4 THEN {_SEGMENT} || ' Hospital' WHEN 5 THEN 'Dr.' WHEN 6 THEN 'रवि कुमार' END"}, names.is_person, "c_custkey % 8 IN (0, 1, 6)")


def _known() -> Column:
    return F.create_map(F.lit("Asha Rao"), F.array(F.lit("ஆஷா ராவ்")))


rule("missing_people", "customer", "c_custkey", {"second": f"'Mr. ' || {_SEGMENT}", "t": f"CASE c_custkey % 4 WHEN 0 THEN 'Asha Rao pays' WHEN 1 THEN 'நோயாளி ஆஷா ராவ்' WHEN 2 THEN 'Mr. ' || {_SEGMENT} || ' and ஆஷா ராவ்' ELSE 'nobody' END"},
     lambda s, t: F.concat_ws("|", F.array_join(names.names_left_out(F.array(F.lit("Asha Rao"), F.lit("Claims Department"), s), _known(), F.array(t)), ","), names.mask_fallback(F.array(F.lit("Asha Rao"), s), _known(), F.array(t)).cast("string")),
     "CASE c_custkey % 4 WHEN 2 THEN '|false' WHEN 3 THEN 'Asha Rao,' || second || '|true' ELSE second || '|true' END")
rule("name_renderings", "customer", "c_custkey", {"name": "c_name", "seg": _SEGMENT, "t": f"'Dr. Asha Rao on ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'x' END", "u": f"CASE WHEN c_custkey % 3 = 0 THEN 'Patient Ravi ' || {_SEGMENT} END"},
     lambda n, s, t, u: F.array_join(F.map_keys(names.renderings(F.array(n, F.lit("gone")), F.array(t, u))), ","), "concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN name END, 'Asha Rao', CASE WHEN u IS NOT NULL THEN 'Ravi ' || seg END)")
rule("merged_renderings", "customer", "c_custkey", {"seg": _SEGMENT, "t": f"CASE WHEN c_custkey % 3 = 0 THEN {_SEGMENT} || ' pays' ELSE 'nobody' END"},
     lambda s, t: F.array_join(F.transform(F.map_entries(names.merged_renderings(F.create_map(F.lit("Asha Rao"), F.array(F.lit("A R"))), F.create_map(F.lit("Asha Rao"), F.array(F.concat(F.lit(" "), s), F.lit("Q")), F.lit("Z"), F.array(F.lit("zz"))), F.array(t))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";"),
     "'Asha Rao=A R' || CASE WHEN c_custkey % 3 = 0 THEN '+' || seg ELSE '' END")
rule("list_guards", "orders", "o_orderkey", {"c": _C, "k": _K, "same": "o_custkey % 3 > 0", "full_length": "o_orderkey % 2 = 0"},
     lambda c, k, s, b: _joined(**{n: guards.lists_keep_numbers(F.array(F.concat(F.lit("pay "), c), F.concat(F.lit("on "), k)), F.when(b, F.array(F.concat(F.when(s, c).otherwise("none"), F.lit(" दें")), F.concat(k, F.lit(" को")))).otherwise(F.array(F.concat(F.when(s, c).otherwise("none"), F.lit(" दें")))), cut=v) for n, v in (("whole", False), ("cut", True))}),
     "CAST(same AND full_length AS VARCHAR) || '|' || CAST(same AS VARCHAR)")
rule(
    "spoken_summaries", "orders", "o_orderkey", {"spoken": f"CASE o_orderkey % 4 WHEN 0 THEN 'Pay ' || {_C} || ' soon.' WHEN 1 THEN 'Pay ' || {WHOLE} || '5.' WHEN 2 THEN '' END", "line": f"CASE o_custkey % 3 WHEN 0 THEN 'Pay ' || {_C} WHEN 1 THEN 'Pay 77' || {WHOLE} ELSE '' END", "doc": f"'amount ' || {_C} || ' due'", "due": f"CASE WHEN o_custkey % 2 = 0 THEN {_ISO} END", "k": "o_custkey % 3"},
    lambda s, l, d, u, k: answers.spoken_summary(s, F.array(l, F.lit(" by Monday ")), F.lit("Bill"), F.lit("Pay now"), u, d, F.array().cast("array<string>")),
    """CASE WHEN coalesce(spoken, '') <> '' AND o_orderkey % 4 = 0 THEN spoken WHEN k = 0 THEN line || ' by Monday' WHEN k = 2 THEN 'by Monday'
      ELSE 'This is an official document regarding Bill. Please review the key details. Pay now' || coalesce(' by ' || due, '') || '.' END""",
)
rule("spoken_texts_in_telugu", "orders", "o_orderkey", {"w": WHOLE, "t": f"'₹ ' || {WHOLE} || ' on ' || {_DAY} || '.' || {_MONTH} || '.' || {_YEAR}"}, lambda w, t: speech.spoken(t, "te-IN"), "w || ' రూపాయలు on ' || replace(right(t, 10), '.', '-')")
rule("presented_dates", "orders", "o_orderkey", {"due": _DUE, "status": _STATUS, "rec": _RECURS, "checked": "CASE o_orderkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'calculated' END", "quote": "CASE WHEN o_custkey % 4 > 0 THEN 'q' END", "photo": "o_custkey % 7 = 0"},
     lambda d, s, r, e, q, p: bind(lambda x: F.concat_ws("|", x["d"]["passed"].cast("string"), x["d"]["chip"], x["d"]["in_calendar"].cast("string")), d=results.presented_date(d, s, r, e, q, p, _today())),
     f"SELECT o_orderkey, concat_ws('|', CAST(passed AS VARCHAR), CASE WHEN checked IS NOT NULL THEN checked WHEN NOT photo AND quote IS NOT NULL THEN 'check_original' END, CAST(NOT passed AND (due IS NOT NULL OR rec IS NOT NULL) AS VARCHAR)) AS result FROM (SELECT *, {_PASSED} OR coalesce(status = 'passed', false) AS passed FROM given)")
rule("typed_kinds", "part", "p_partkey", {"t": "CASE p_size % 4 WHEN 0 THEN 'the premium of ' || p_name ELSE '' END", "n": "CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END", "kind": "CASE p_partkey % 5 WHEN 0 THEN 'tax_receipt' WHEN 1 THEN 'medical' WHEN 2 THEN 'zzz' END"},
     lambda t, n, k: decoders.document_kind(F.lit(None).cast("string"), t, n, F.lit(0), k),
     "CASE WHEN n > 0 THEN 'prescription' WHEN t <> '' THEN 'insurance' WHEN kind = 'tax_receipt' THEN 'tax_notice' WHEN kind = 'medical' THEN 'lab_report' ELSE 'other' END")
_FAMILY = "CASE kind WHEN 'lab_report' THEN 'lab' WHEN 'receipt' THEN 'bill' WHEN 'challan' THEN 'legal' WHEN 'tax_notice' THEN 'gov' WHEN 'loan' THEN 'money' ELSE 'generic' END"
_ASKED = {"kind": "CASE p_partkey % 7 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'receipt' WHEN 2 THEN 'challan' WHEN 3 THEN 'school' WHEN 4 THEN 'tax_notice' WHEN 5 THEN 'loan' END"}
rule("question_families", "part", "p_partkey", _ASKED, blocks.ask_family, _FAMILY)
rule("starter_questions", "part", "p_partkey", _ASKED, lambda k: F.array_join(blocks.starter_chips(k), ","), f"SELECT p_partkey, 'ask' || f || '1,ask' || f || '2,ask' || f || '3' AS result FROM (SELECT p_partkey, upper(substr({_FAMILY}, 1, 1)) || substr({_FAMILY}, 2) AS f FROM given)")
rule("reading_variants", "part", "p_partkey", {"photo": "p_size % 5 = 0", "files": "p_size % 3 + 1", "lang": _LANG, "was": "CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END", "forced": "CASE p_partkey % 11 WHEN 0 THEN 'B' WHEN 1 THEN 'x' END"}, blocks.reading_variant,
     "SELECT p_partkey, CASE WHEN forced = 'B' THEN 'B' WHEN was = pick THEN translate(pick, 'ABCD', 'BCDA') ELSE pick END AS result FROM (SELECT *, CASE WHEN photo OR files > 1 THEN 'B' WHEN lang IS NOT NULL THEN 'C' WHEN was = 'A' THEN 'D' ELSE 'A' END AS pick FROM given)")
rule("parts_alone", "part", "p_partkey", {"title": "p_name", "kind": "CASE WHEN p_size % 2 = 0 THEN p_type END", "own": "CASE WHEN p_size % 3 = 0 THEN 'tax' END"},
     lambda t, k, o: bind(lambda x: F.concat_ws("|", x["r"]["doc_type"], x["r"]["document_kind"], x["r"]["title"], x["r"]["language"], x["r"]["letter_date"], F.array_join(x["r"]["summary"], ",")), r=blocks.part_as_result(F.struct(t.alias("title"), o.alias("document_type"), k.alias("document_kind"), F.lit("2026-10-01").alias("date_iso"), F.array(t, k).alias("summary_lines")), F.lit("ta"), F.lit("bank"))),
     "concat_ws('|', coalesce(own, 'bank'), kind, title, 'ta', '2026-10-01', concat_ws(',', title, kind))")
rule("result_titles", "part", "p_partkey", {"kind": "CASE WHEN p_size % 3 > 0 THEN p_type ELSE '' END", "issuer": "CASE p_size % 4 WHEN 0 THEN p_brand || ', City' WHEN 1 THEN 'Dr. Rao' WHEN 2 THEN '' END", "day": "CASE WHEN p_partkey % 2 = 0 THEN '2026-10-01' ELSE '' END", "title": "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END"}, overview.result_title,
     "coalesce(nullif(concat_ws(' · ', nullif(kind, ''), CASE WHEN contains(issuer, ', City') THEN split_part(issuer, ',', 1) END, CASE WHEN day <> '' THEN '1 Oct' END), ''), nullif(title, ''), 'Document')")
rule(
    "feedback_admitted", "events", "event_id",
    {"rating": "CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'none' END", "lang": "CASE WHEN user_id % 9 = 0 THEN 'fr' WHEN user_id % 2 = 0 THEN 'ta' ELSE 'en' END", "reason": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other' WHEN 2 THEN 'wrong_date' ELSE 'bad' END", "version": "CASE WHEN user_id % 8 = 0 THEN 'a b' ELSE '1.2.' || CAST(user_id AS STRING) END", "signed": "event_id % 11 > 0", "late": "event_id % 13"},
    lambda r, l, x, v, s, m: admission.feedback_allowed(F.when(x.isNull(), F.array(*map(F.lit, _FORM))).otherwise(F.array(*map(F.lit, [*_FORM, "reasons"]))), r, l, F.lit("bank"), F.when(x.isNotNull(), F.array(x)), F.lit("boolean"), v, s, F.when(m > 0, 5).otherwise(6), F.lit(5)),
    "signed AND late > 0 AND lang <> 'fr' AND version <> 'a b' AND ((rating = 'up' AND reason IS NULL) OR (rating = 'down' AND coalesce(reason IN ('other', 'wrong_date'), false)))",
)

# Blocks and layouts: a field of each family is there or not by the number of the part; kinds take turns.
_KINDS = ["government_notice", "tax_notice", "challan", "court_legal", "invoice", "lab_report", "prescription", "discharge_summary", "hospital_bill", "loan", "agreement", "form", "other", "insurance", "school", "receipt", "utility_bill", "pension_notice", "bank_statement", "telecom_bill"]
_PROFILE = ["directions", "how_to_pay", "consequence", "line_items", "warranty_until", "diagnosis_as_written", "medicines", "advice_lines", "charges", "emi_amount", "deposit", "end_date", "form_fields", "summary", "actions", "deduction_reasons", "contacts", "facts", "follow_up", "premium"]
_TURN = f"CASE p_partkey % {len(_KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_SHOWN = {
    "kind": _TURN, "n": "CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 8 AS INT) ELSE 0 END", "dated": "p_size % 4 = 0", "parts": "CAST(p_size % 5 % 3 AS INT)", "generic": "CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'E' ELSE 'F' END", "money": "p_size % 7 = 0", "due": "p_size % 2 = 0",
    **{f: f"(p_partkey + p_size * {i + 3}) % {3 + i % 4} = 0" for i, f in enumerate(_PROFILE)},
}


def _has(fields: tuple[Column, ...]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(f)) for f, c in zip(_PROFILE, fields, strict=True))), lambda x: x.isNotNull())


rule(
    "shown_blocks", "part", "p_partkey", _SHOWN, lambda kind, n, dated, parts, generic, money, due, *fields: F.array_join(blocks.blocks(_has(fields), kind, n, dated), ","),
    """concat_ws(',', CASE WHEN kind = 'government_notice' AND directions AND NOT dated THEN 'directions' END, CASE WHEN kind = 'tax_notice' AND how_to_pay THEN 'waysToPay' END, CASE WHEN kind = 'challan' AND how_to_pay THEN 'howToContest' END,
      CASE WHEN kind = 'court_legal' AND consequence THEN 'consequence' END, CASE WHEN kind IN ('invoice', 'hospital_bill') AND line_items THEN 'items' END, CASE WHEN kind = 'invoice' AND warranty_until THEN 'warranty' END,
      CASE WHEN kind = 'lab_report' AND n > 0 THEN 'sections' END, CASE WHEN kind = 'lab_report' THEN 'notADiagnosis' END, CASE WHEN kind = 'discharge_summary' AND diagnosis_as_written THEN 'diagnosis' END,
      CASE WHEN kind IN ('prescription', 'discharge_summary') AND medicines THEN 'medicines' END, CASE WHEN kind = 'discharge_summary' AND advice_lines THEN 'advice' END, CASE WHEN kind = 'loan' AND emi_amount THEN 'nextEmi' END, CASE WHEN kind = 'loan' AND charges THEN 'loanTerms' END,
      CASE WHEN kind = 'agreement' AND deposit THEN 'keyTerms' END, CASE WHEN kind = 'agreement' AND end_date THEN 'timeline' END, CASE WHEN kind = 'form' AND form_fields THEN 'formSteps' END,
      CASE WHEN summary THEN 'simpleWords' END, CASE WHEN actions THEN 'actions' END, CASE WHEN deduction_reasons THEN 'watchOut' END, CASE WHEN contacts THEN 'places' END, CASE WHEN facts THEN 'facts' END)""",
)
rule(
    "kind_layouts", "part", "p_partkey", _SHOWN, lambda kind, n, dated, parts, generic, money, due, *fields: blocks.layout(kind, parts, n, generic, _has(fields), dated, money, due),
    """CASE WHEN parts > 1 THEN 'multi' ELSE CASE kind WHEN 'lab_report' THEN CASE WHEN n > 4 THEN 'Dplus' ELSE 'D' END WHEN 'prescription' THEN 'E' WHEN 'form' THEN 'E' WHEN 'agreement' THEN 'E' WHEN 'other' THEN 'E'
      WHEN 'discharge_summary' THEN CASE WHEN follow_up THEN 'C' ELSE 'E' END WHEN 'hospital_bill' THEN 'F' WHEN 'bank_statement' THEN 'F' WHEN 'loan' THEN CASE WHEN emi_amount THEN 'B' ELSE 'F' END WHEN 'invoice' THEN CASE WHEN due THEN 'B' ELSE 'F' END
      WHEN 'insurance' THEN CASE WHEN premium THEN 'B' WHEN generic = 'A' THEN 'A' ELSE 'F' END WHEN 'challan' THEN 'B' WHEN 'tax_notice' THEN 'B' WHEN 'school' THEN CASE WHEN dated AND NOT money THEN 'C' ELSE 'B' END WHEN 'court_legal' THEN 'C' WHEN 'pension_notice' THEN 'C'
      WHEN 'government_notice' THEN CASE WHEN dated THEN 'C' ELSE 'E' END WHEN 'utility_bill' THEN CASE WHEN generic = 'A' THEN 'A' ELSE 'B' END WHEN 'receipt' THEN CASE WHEN generic = 'B' THEN 'B' ELSE 'F' END ELSE generic END END""",
)
_MEDICINE = "CASE p_size % 5 WHEN 0 THEN '1-0-1' WHEN 1 THEN '0-0-1 x ' || CAST(p_partkey % 3 + 2 AS STRING) || ' weeks' WHEN 2 THEN 'BD before food' WHEN 3 THEN '' ELSE 'OD' END"
rule(
    "printed_medicine_times", "part", "p_partkey", {"k": "p_size % 5", "raw": _MEDICINE, "food": "CASE p_size % 5 WHEN 0 THEN 'after_food' WHEN 1 THEN 'At Bedtime' WHEN 2 THEN 'unknown' END", "days": "CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 + 1 AS INT) END", "weeks": "p_partkey % 3 + 2"},
    lambda k, r, f, d, w: bind(lambda x: F.concat_ws("|", F.array_join(x["m"]["slots"], ","), x["m"]["food"], x["m"]["days"].cast("string")), m=decoders.medicine_frequency(r, f, d)),
    "CASE k WHEN 0 THEN concat_ws('|', 'morning,night', 'after_food', days) WHEN 1 THEN 'bedtime|at_bedtime|' || 7 * weeks WHEN 2 THEN concat_ws('|', 'morning,night', 'before_food', days) WHEN 3 THEN concat_ws('|', '', days) ELSE concat_ws('|', 'morning', days) END",
)


def _activity(key: Column, done: bool, rating: Column, lang: Column, report: Column) -> Column:
    some = lambda kind: F.create_map(key, F.lit(done).cast(kind))
    flags = [some("boolean").alias(n) for n in ("done", "added", "slots")]
    return F.struct(*flags, some("string").alias("times"), some("int").alias("durations"), rating.alias("rating"), lang.alias("lang"), report.alias("report"))


rule(
    "activity_patches", "part", "p_partkey", {"name": "p_name", "kind": "p_type", "size": "CAST(p_size AS INT)", "a": "p_size % 2 = 0", "b": "p_size % 3 = 0", "c": "p_partkey % 2 = 0", "d": "p_partkey % 3 = 0"},
    lambda name, kind, size, a, b, c, d: bind(
        lambda x: F.concat_ws("|", F.array_join(F.transform(F.map_entries(x["r"]["done"]), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.array_join(F.map_keys(x["r"]["slots"]), ","), x["r"]["rating"], x["r"]["lang"], F.coalesce(x["r"]["report"].cast("string"), F.lit(""))),
        r=dues.activity_with(_activity(name, True, F.lit("up"), F.lit("en"), size), _activity(kind, False, F.lit(None).cast("string"), kind, F.lit(None).cast("int")), F.filter(F.array(F.when(a, "done"), F.when(b, "medicine"), F.when(c, "rating"), F.when(d, "report"), F.when(a & b, "lang")), lambda x: x.isNotNull())),
    ),
    "concat_ws('|', CASE WHEN a THEN kind || '=false' ELSE name || '=true' END, CASE WHEN b THEN kind ELSE name END, CASE WHEN c THEN '' ELSE 'up' END, CASE WHEN a AND b THEN kind ELSE 'en' END, CASE WHEN d THEN '' ELSE CAST(size AS VARCHAR) END)",
)


@query(
    f"""WITH given AS (SELECT c_custkey, {_BORN} AS born, {_STARS} AS stars, c_custkey % 2 = 0 AS told FROM customer)
SELECT c_custkey, stars || '|7|' || CASE WHEN told THEN 'DOB: [hidden]' ELSE 'no date' END || '|on ' || CASE WHEN told THEN '[hidden]' ELSE replace(born, '/', '.') END || ', call **********|kept' AS result FROM given"""
)
def masked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results: a birth date that a heading states is hidden in other lines too, also in another form."""
    rows = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", f"{_BORN_SPARK} AS born"), "c_custkey")
    heading = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("DOB: "), "born")).otherwise("no date")
    line = F.concat(F.lit("on "), F.replace(F.col("born"), F.lit("/"), F.lit(".")), F.lit(", call 9876543210"))
    result = F.struct(F.col("c_name").alias("title"), F.lit(7).alias("n"), F.array(F.struct(heading.alias("heading"), F.array(line).alias("lines"))).alias("parts"), F.create_map(F.lit("k"), F.lit("kept")).alias("notes"))
    given = rows.select("c_custkey", "c_name", result.alias("result"))
    made = given.select("c_custkey", sharing.masked_result(F.col("result"), given.schema["result"].dataType, F.array("c_name")).alias("r"))
    return made.select("c_custkey", F.concat_ws("|", "r.title", F.col("r.n").cast("string"), F.col("r.parts")[0]["heading"], F.col("r.parts")[0]["lines"][0], F.col("r.notes")["k"]).alias("result"))
