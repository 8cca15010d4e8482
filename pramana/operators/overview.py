"""Overviews of results: totals, order, flagged values, packets of several reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decoders import lab_value


def all_matched(values: DataFrame, *by: str) -> DataFrame:
    """Whether every value of a group, one at least, is matched."""
    return values.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("evidence") == "matched", F.lit(False))).alias("all_matched"))


def flagged_values(values: DataFrame) -> DataFrame:
    """Values (doc_id, section, pos, label, value, ref_range, flag, page) outside their range, with the label of the flag, in reading order."""
    rows = values.withColumn("found", F.explode(F.array(lab_value(F.col("value"), F.col("ref_range"), F.col("flag")))))
    return rows.where(F.col("found.outside")).select("doc_id", "section", "pos", "label", "value", F.col("found.label").alias("flag"), "page")


def ranges(values: DataFrame, found: str, *by: str) -> DataFrame:
    """Decided values (found: label, outside) of each group: how many are outside, how many there are, whether all are in range; groups without one are left out."""
    decided = values.where(F.col(found).isNotNull())
    return decided.groupBy(*by).agg(F.count_if(F.col(found)["outside"]).alias("outside"), F.count(F.lit(1)).alias("decided"), F.bool_and(~F.col(found)["outside"]).alias("all_in_range"))


def section_order(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, pos, page) with their place by page; those without a page first, equal pages as they came."""
    return sections.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), "pos")))


def next_up(reminders: DataFrame, by: str) -> DataFrame:
    """The first upcoming reminder (date, time, pos, status) of each owner; a blank time is midnight."""
    when = F.struct(F.concat(F.col("date"), F.lit("T"), F.coalesce(F.nullif("time", F.lit("")), F.lit("00:00"))), F.col("pos"))
    return reminders.where("status = 'upcoming'").groupBy(by).agg(F.min_by("summary", when).alias("summary"), F.min(F.col("date")).alias("date"))


def reminder_order(reminders: DataFrame, by: str, past: bool = False) -> DataFrame:
    """Reminders with their place: upcoming ones by time, past ones the latest first; equal times as they came."""
    at = F.concat(F.col("date"), F.lit("T"), F.coalesce(F.nullif("time", F.lit("")), F.lit("00:00")))
    window = Window.partitionBy(by).orderBy(at.desc() if past else at.asc(), "pos")
    return reminders.where(F.col("status") == ("past" if past else "upcoming")).withColumn("place", F.row_number().over(window))


def packets(reports: DataFrame, by: str) -> DataFrame:
    """Reports (pos, title, file, status, bytes, pages) of each packet as one: title with how many more, how many are ready, totals.

    The title is the first one, else the first file's name; a title that only counts reports is not taken.
    """
    first = F.coalesce(F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("pos"))), F.min_by("file", "pos"))
    sums = reports.groupBy(by).agg(
        first.alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ready").alias("ready"), F.min(F.when(F.col("status") == "ready", F.col("pos"))).alias("first_ready"), F.sum("bytes").alias("bytes"), F.sum("pages").alias("pages")
    )
    counted = F.concat(F.col("n").cast("string"), F.lit(" reports"))
    more = F.concat(F.col("first"), F.lit(" + "), (F.col("n") - 1).cast("string"), F.lit(" more"))
    title = F.when((F.coalesce("first", F.lit("")) != "") & (F.col("n") > 1) & ~F.col("first").rlike(r"(?i)^\d+\s+reports?$"), more).otherwise(counted)
    return sums.select(by, title.alias("title"), "ready", "first_ready", "bytes", "pages")


def result_title(kind_name: Column, issuer: Column, day: Column, title: Column) -> Column:
    """The default name of a result, else its title, else Document."""
    from .results import default_name

    return F.coalesce(F.nullif(default_name(kind_name, issuer, day), F.lit("")), F.nullif(title, F.lit("")), F.lit("Document"))


def active_sentence(sentences: DataFrame, by: str, played: Column) -> DataFrame:
    """The sentence (pos, text) that sounds when a share of the time is `played`: the first whose characters reach that share."""
    w = Window.partitionBy(by)
    ends = F.sum(F.length("text")).over(w.orderBy("pos")) / F.sum(F.length("text")).over(w)
    rows = sentences.withColumn("ends", ends).withColumn("played", played)
    return rows.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("played") <= F.col("ends"), F.col("pos"))), F.max("pos")).alias("active"))
