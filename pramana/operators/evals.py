"""Evaluations: expected facts against results, wrongly matched items, dictionaries with gaps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_form
from ..sources.shared import written
from .evidence import document_text


def wrongly_matched(items: DataFrame, pages: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """How many items (doc_id, quote, evidence) of each document are called matched though the document lacks their quote.

    The matched quotes of a document are gathered first, so its text is joined once.
    """
    matched = items.where((F.col("evidence") == "matched") & (F.coalesce("quote", F.lit("")) != ""))
    quotes = matched.select("doc_id", evidence_form(F.col("quote"), unicode_forms).alias("q")).groupBy("doc_id").agg(F.collect_list("q").alias("quotes"))
    texts = document_text(pages).select("doc_id", evidence_form(F.col("text"), unicode_forms).alias("t"))
    missing = F.filter("quotes", lambda q: ~F.contains(F.coalesce("t", F.lit("")), q))
    return quotes.join(texts, "doc_id", "left").select("doc_id", F.size(missing).alias("wrongly_matched"))


def case_verdict(result: Column, expected: Column, wrong: Column) -> Column:
    """(passed, notes) of a result (document_type, source_kind, protected_terms) against what a case expects; a term that is missing is noted only."""
    differs = lambda name, said: F.when(expected[name].isNotNull() & ~F.coalesce(result[name], F.lit("")).eqNullSafe(expected[name]), F.lit(said))
    absent = F.array_except(expected["protected_terms"], result["protected_terms"])
    wrongly = F.array_intersect(expected["excluded_protected_terms"], result["protected_terms"])
    failed = F.array(differs("document_type", "document_type"), differs("source_kind", "source_kind"), F.when(F.size(wrongly) > 0, F.concat(F.lit("excluded: "), F.array_join(wrongly, "+"))), F.when(wrong > 0, F.concat(F.lit("wrongly_matched="), wrong.cast("string"))))
    failed = F.filter(failed, lambda x: x.isNotNull())
    notes = F.concat(failed, F.when(F.size(absent) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(absent, "+")))).otherwise(F.array().cast("array<string>")))
    return F.struct((F.size(failed) == 0).alias("passed"), F.when(F.size(notes) > 0, F.array_join(notes, ", ")).otherwise("All checks passed").alias("notes"))


def report_lines(cases: DataFrame) -> DataFrame:
    """Rows of a Markdown table (name, document_type, seconds, wrongly_matched, passed, notes), one for each case."""
    cell = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("name"), cell("document_type"), F.format_number("seconds", 2), cell("wrongly_matched"), F.when(F.col("passed"), "**PASS**").otherwise("**FAIL**"), cell("notes")), F.lit(" |"))
    return cases.select("name", line.alias("line"))


REPORT_HEAD = ["| Case | Document Type | Source Kind | Explain (s) | Translate (s) | Wrongly Matched | Status | Notes |", "|---|---|---|---|---|---|---|---|"]


def report_file(cases: DataFrame, title: str, made: str, base_url: str) -> DataFrame:
    """(place, line): a whole report in Markdown. Heading, time and address, then a line for each case in order of its id, and a blank one.

    cases: id, name, document_type, source_kind, explain_sec, translate_sec, wrongly_matched, passed, notes.
    """
    spark = cases.sparkSession
    head = [f"# {title}", "", f"Generated on: {made}", f"Base URL: `{base_url}`", "", *REPORT_HEAD]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    seconds = lambda c: F.format_string("%.2f", F.bround(F.coalesce(F.col(c), F.lit(0.0)), 2))
    status = F.when(F.coalesce("passed", F.lit(False)), "**PASS**").otherwise("**FAIL**")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", text("name"), text("document_type"), text("source_kind"), seconds("explain_sec"), seconds("translate_sec"), F.coalesce("wrongly_matched", F.lit(0)).cast("string"), status, text("notes")), F.lit(" |"))
    # Cases are numbered by counts of ranges, not in one task.
    ranged = cases.select("id", line.alias("line")).repartitionByRange("id").sortWithinPartitions("id").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"), "line")
    ranged = written(ranged, "report")
    before = {r["part"]: (r["least"], r["n"]) for r in ranged.groupBy("part").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
    offsets, seen = [], len(head)
    for part in sorted(before):
        offsets.append((part, seen - before[part][0]))
        seen += before[part][1]
    numbered = ranged.join(F.broadcast(spark.createDataFrame(offsets, "part int, shift long")), "part").select((F.col("n") + F.col("shift")).alias("place"), "line")  # a row for each range
    rest = spark.createDataFrame([*enumerate(head), (seen, "")], "place long, line string")
    return numbered.unionByName(rest)


def words_missing(words: DataFrame, languages: list[str], used: DataFrame | None = None, default: str = "en") -> DataFrame:
    """(lang, key) of keys of the default language, or used ones, that a language's dictionary (lang, key) lacks."""
    keys = words.where(F.col("lang") == default).select("key")
    if used is not None:
        keys = keys.unionByName(used.select("key"))
    wanted = keys.distinct().select(F.explode(F.array(*map(F.lit, languages))).alias("lang"), "key")
    return wanted.join(words.select("lang", "key").distinct(), ["lang", "key"], "left_anti")


def still_to_build(files: DataFrame, languages: list[str], built: DataFrame) -> DataFrame:
    """(file, lang) of bundled results that have not been built yet, English first; built: (file, lang)."""
    wanted = files.select("file", F.posexplode(F.array(*map(F.lit, ["en", *(x for x in languages if x != "en")]))).alias("place", "lang"))
    return wanted.join(built.select("file", "lang"), ["file", "lang"], "left_anti").select("file", "lang", "place")
