"""What leaves the engine as text: calendar entries, links, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(t: Column) -> Column:
    """Text of a calendar property: backslash, semicolon, comma and line ends escaped."""
    t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(F.replace(t, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.regexp_replace(t, r"\r\n|\r|\n", r"\\n")


def folded(line: Column) -> Column:
    """A content line cut into rows of at most 75 octets: CR LF and a blank before each further row.

    Folds over characters with octet counts, so no character is cut in two.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def add(a: Column, c: Column) -> Column:
        n = F.octet_length(c)
        fits = a["used"] + n <= 75
        return F.struct(F.concat(a["out"], F.when(fits, c).otherwise(F.concat(F.lit("\r\n "), c))).alias("out"), F.when(fits, a["used"] + n).otherwise(1 + n).cast("int").alias("used"))

    long = F.aggregate(F.split(line, ""), start, add)["out"]
    return F.when(F.octet_length(line) <= 75, line).otherwise(long)


def calendar_entry(uid: Column, day: Column, time: Column, summary: Column, rule: Column) -> Column:
    """One event: all day without a time, else floating local time; an optional repeat rule."""
    stamp = F.date_format(day, "yyyyMMdd")
    start = F.when(F.coalesce(time, F.lit("")) == "", F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp)).otherwise(F.concat(F.lit("DTSTART:"), stamp, F.lit("T"), F.replace(time, F.lit(":"), F.lit("")), F.lit("00")))
    lines = F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), start, F.concat(F.lit("RRULE:"), F.nullif(rule, F.lit(""))), folded(F.concat(F.lit("SUMMARY:"), escaped(summary))), F.lit("END:VEVENT"))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\r\n")


def search_link(base: str, t: Column) -> Column:
    """A link with the text as its query; blanks as %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")))
