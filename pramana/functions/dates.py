"""Dates, deadlines and their status as Column expressions. Every function takes an explicit day as `today`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .deadlines import reading
from .text import bind

# Month names, in full and short.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# English number words of deadlines.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


# The shapes of dates (ISO, day-month-year, and the two orders with month names).
_ISO, _DMY = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
_NAMED, _AMERICAN = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"


def _month_number(name: Column) -> Column:
    """The number of a month by its full or short name (and sept) as two digits; null for other words."""
    numbers = {name: i for names in (MONTHS, [m.lower() for m in SHORT_MONTHS]) for i, name in enumerate(names, 1)} | {"sept": 9}
    known = F.create_map(*(F.lit(x) for name, i in numbers.items() for x in (name, f"{i:02d}")))
    return F.try_element_at(known, F.lower(name))


def parse_date(t: Column) -> Column:
    """ISO, day-month-year, and the two orders with month names; null for anything else and for days that do not exist.

    The text is looked at once for each shape, and taken apart for the one that fits.
    """

    def decide(x: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(x["t"], pattern, i)
        two = lambda n: F.lpad(n, 2, "0")
        shapes = [
            (_ISO, part(_ISO, 1), two(part(_ISO, 2)), two(part(_ISO, 3))), (_DMY, part(_DMY, 3), two(part(_DMY, 2)), two(part(_DMY, 1))),
            (_NAMED, part(_NAMED, 3), _month_number(part(_NAMED, 2)), two(part(_NAMED, 1))), (_AMERICAN, part(_AMERICAN, 3), _month_number(part(_AMERICAN, 1)), two(part(_AMERICAN, 2))),
        ]
        found = F.lit(None).cast("string")
        for pattern, year, month, day in reversed(shapes):
            found = F.when(x["t"].rlike(pattern), F.concat(year, F.lit("-"), month, F.lit("-"), day)).otherwise(found)
        return F.try_to_date(found, "yyyy-MM-dd")

    return bind(decide, t=F.trim(t))


def human_date(d: Column) -> Column:
    """As in 1 Oct 2026."""
    return F.date_format(d, "d MMM yyyy")


def status(due: Column, calculated: Column, recurring: Column, today: Column) -> Column:
    """recurring, calculated, none, passed or upcoming, in that order."""
    day = parse_date(due)
    return F.when(recurring, "recurring").when(calculated, "calculated").when(day.isNull(), "none").when(day < today, "passed").otherwise("upcoming")


def english_span(t: Column) -> Column:
    """(count, unit) of a deadline in English words: within N hours, days, weeks or months; null if there is none."""
    low = F.lower(t)
    for i, word in enumerate(NUMBER_WORDS):
        low = F.regexp_replace(low, rf"\b{word}\b", str(i + 1))
    pattern = r"\bwithin\b[^.;]{0,24}?\b(\d+)\s*(hour|day|week|month)s?\b"
    found = lambda x: F.struct(F.regexp_extract(x["low"], pattern, 1).try_cast("int").alias("count"), F.regexp_extract(x["low"], pattern, 2).alias("unit"))
    return bind(lambda x: F.when(x["r"]["count"] > 0, x["r"]), r=bind(found, low=low))


def due_date(anchor: Column, span: Column) -> Column:
    """(due, days) of a span counted from an anchor day; hours are rounded up to days; months stop at month ends."""

    def counted(x: Column) -> Column:
        count, unit = x["span"]["count"], x["span"]["unit"]
        due = (
            F.when(unit == "hour", F.date_add(x["anchor"], F.ceil(count / 24).cast("int")))
            .when(unit == "week", F.date_add(x["anchor"], count * 7))
            .when(unit == "month", F.add_months(x["anchor"], count))
            .otherwise(F.date_add(x["anchor"], count))
        )
        return F.struct(due.alias("due"), F.datediff(due, x["anchor"]).alias("days"))

    return bind(lambda x: F.when(x["r"]["days"] > 0, x["r"]), r=bind(counted, anchor=anchor, span=span))


# Dates in running text, and words of payment beside them.
PRINTED_DATE = r"(?i)(?:\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b)"
PAYMENT = r"(?i)\b(pay|payment|last\s+date)\b"
LETTER_DATE = r"(?i)Date:\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4}|\d{1,2}[./-]\d{1,2}[./-]\d{4})"
BESIDE = 60


def payment_conflict(t: Column) -> Column:
    """The different dates within 60 characters of words of payment, in order, if there are two or more; else null.

    Each date is judged by itself, its neighbours of BESIDE characters and the parts
    of other dates that fall into them: a walk over the gaps carries what stands before.
    """

    def near(x: Column) -> Column:
        def step(state: Column, hit: Column) -> Column:
            """Carries the last BESIDE characters before the next gap, the number of the hit, and the days found."""
            n = state["n"]
            before = F.right(F.concat(state["before"], F.get(x["gaps"], n)), F.lit(BESIDE))
            after = F.left(F.concat(F.get(x["gaps"], n + 1), F.coalesce(F.get(x["hits"], n + 1), F.lit("")), F.coalesce(F.get(x["gaps"], n + 2), F.lit("")), F.coalesce(F.get(x["hits"], n + 2), F.lit("")), F.coalesce(F.get(x["gaps"], n + 3), F.lit(""))), F.lit(BESIDE))
            found = F.concat(before, hit, after).rlike(PAYMENT)
            return F.struct(F.concat(before, hit).alias("before"), (n + 1).alias("n"), F.when(found, F.array_append(state["found"], hit)).otherwise(state["found"]).alias("found"))

        start = F.struct(F.lit("").alias("before"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("found"))
        return F.array_distinct(F.aggregate(x["hits"], start, step, lambda s: s["found"]))

    def decide(x: Column) -> Column:
        days = F.array_sort(F.array_distinct(F.filter(F.transform(x["found"], parse_date), lambda d: d.isNotNull())))
        return bind(lambda d: F.when(F.size(d["days"]) >= 2, F.array_join(F.transform(d["days"], human_date), " and ")), days=days)

    found = bind(near, hits=F.regexp_extract_all(t, F.lit(PRINTED_DATE), F.lit(0)), gaps=F.split(t, PRINTED_DATE, -1))
    return bind(decide, found=found)


def letter_date(printed: Column, pages: Column) -> Column:
    """The day of a letter as ISO text: the given one (as it is, if it can't be read), else the first `Date:` of the pages."""
    given = F.coalesce(F.nullif(printed, F.lit("")), F.lit(""))
    fallback = parse_date(F.regexp_extract(F.coalesce(pages, F.lit("")), LETTER_DATE, 1)).cast("string")
    return F.when(given != "", F.coalesce(parse_date(given).cast("string"), given)).otherwise(fallback)


def days_after_letter(days: Column, letter: Column, anchor: Column) -> Column:
    """The letter's day and so many days; null unless days count from the letter."""
    return F.when(F.coalesce(F.nullif(anchor, F.lit("")), F.lit("letter_date")) == "letter_date", F.date_add(parse_date(letter), days))


def resolved_deadline(quote: Column, text: Column, anchor: Column) -> Column:
    """(verdict, due, days): computed from the first of quote and text that gives a day; drop where a deadline can't be counted; else skip.

    An English sentence goes ahead of a quote in another language; the text is asked
    only then, or if the quote is blank or has a word for within.
    """
    q, t = F.trim(F.coalesce(quote, F.lit(""))), F.trim(F.coalesce(text, F.lit("")))
    english = lambda r, s: r["count"].isNotNull() & s.rlike(r"(?i)(?<![\p{L}\p{N}_])within(?![\p{L}\p{N}_])")
    day = parse_date(anchor)
    span = lambda r: F.when(r["count"].isNotNull(), F.struct(r["count"].alias("count"), r["unit"].alias("unit")))

    def decide(x: Column) -> Column:
        text_first = (t != "") & (q != "") & english(x["t"], t) & ~english(x["q"], q)
        use_text = (t != "") & (text_first | (q == "") | x["q"]["cue"])
        of_text, of_quote = F.when(use_text, x["dt"]), F.when(q != "", x["dq"])
        found = F.when(text_first, F.coalesce(of_text, of_quote)).otherwise(F.coalesce(of_quote, of_text))
        seen = lambda r: r["count"].isNotNull() | r["unread"]
        saw = ((q != "") & seen(x["q"])) | (use_text & seen(x["t"]))
        verdict = F.when(found.isNotNull(), "computed").when(saw, "drop").otherwise("skip")
        return F.struct(verdict.alias("verdict"), found["due"].alias("due"), found["days"].alias("days"))

    rq, rt = reading(q), reading(t)
    return bind(lambda r: bind(decide, q=r["q"], t=r["t"], dq=due_date(day, span(r["q"])), dt=due_date(day, span(r["t"]))), q=rq, t=rt)


def action_day(recurrence: Column, quote: Column, text: Column, days: Column, anchor: Column, printed: Column, letter: Column, today: Column) -> Column:
    """(due, status, days) of an action: recurring; counted from its words; dropped; counted from its number of days; or as printed."""
    made = lambda due, status_, n: F.struct(due.alias("due"), status_.alias("status"), n.alias("days"))
    none, no_days = F.lit(None).cast("string"), F.lit(None).cast("int")

    def decide(x: Column) -> Column:
        r, counted = x["r"], x["counted"]
        return (
            F.when(F.coalesce(recurrence, F.lit("")) != "", made(none, F.lit("recurring"), days.cast("int")))
            .when(r["verdict"] == "computed", made(r["due"].cast("string"), F.lit("calculated"), r["days"]))
            .when(r["verdict"] == "drop", made(none, F.lit("none"), no_days))
            .when(counted.isNotNull(), made(counted.cast("string"), F.lit("calculated"), days.cast("int")))
            .otherwise(made(printed, status(printed, F.lit(False), F.lit(False), today), days.cast("int")))
        )

    return bind(decide, r=resolved_deadline(quote, text, letter), counted=days_after_letter(days, letter, anchor))


def rolling_day(t: Column) -> Column:
    """The day of an ISO date (a time may follow) or day-month-year, where days and months that run over go on into the next."""
    t = F.trim(t)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s].*)?$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    made = lambda y, m, d: F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)
    return F.coalesce(made(part(iso, 1), part(iso, 2), part(iso, 3)), made(part(dmy, 3), part(dmy, 2), part(dmy, 1)))


def is_passed(t: Column, today: Column) -> Column:
    """Whether a printed day lies before today; false for anything that is no day."""
    return F.coalesce(rolling_day(t) < today, F.lit(False))


def calculated_chip(due: Column, days: Column, word: str = "Calculated", rule: str = "{days} days from the letter date") -> Column:
    """As in Calculated: 31 Oct 2026 (30 days from the letter date); words of another language may be given."""
    shown = F.coalesce(human_date(rolling_day(due)), F.trim(F.coalesce(due, F.lit(""))))
    counted = F.concat(F.lit("("), F.replace(F.lit(rule), F.lit("{days}"), days.cast("string")), F.lit(")"))
    dated = F.when(shown != "", F.concat(F.lit(f"{word}: "), shown)).otherwise(word)
    return F.when(days > 0, F.concat_ws(" ", dated, counted)).otherwise(dated)


def notice_by(end: Column, months: Column, days: Column) -> Column:
    """The day by which notice is due: months count as a calendar that runs over month ends."""
    shifted = F.date_add(F.add_months(F.trunc(end, "MM"), -months), F.day(end) - 1)
    return F.when(months > 0, shifted).when(days > 0, F.date_sub(end, days))


def instalment_rule(day: Column, tenure: Column) -> Column:
    """A monthly calendar rule for a day of the month, if a tenure is known."""
    return F.when(day.between(1, 31) & (F.trim(tenure) != ""), F.concat(F.lit("FREQ=MONTHLY;BYMONTHDAY="), day.cast("string")))


def library_label(day: Column, today: Column) -> Column:
    """this_week (weeks begin on Monday), this_month, or the month."""
    return (
        F.when(F.date_trunc("week", day) == F.date_trunc("week", today), "this_week")
        .when(F.date_trunc("month", day) == F.date_trunc("month", today), "this_month")
        .otherwise(F.date_format(day, "yyyy-MM"))
    )
