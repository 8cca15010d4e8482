"""Calendars: which actions belong in one, drafts, files, links and plain lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import is_passed
from ..functions.sinks import escaped, folded
from ..functions.text import collapse, shorten

# Alarms by choice, and the usual times of doses.
ALARMS = {"1d": "-P1D", "3d": "-P3D", "1w": "-P1W", "0": "-PT0S"}
USUAL_ALARM = "PT9H"
SLOT_TIMES = {"morning": "08:00", "afternoon": "13:00", "evening": "18:00", "night": "21:00", "bedtime": "22:00"}
EVENT = "struct<uid:string,title:string,description:string,start:string,all_day:boolean,alarm:string,rrule:string>"


def eligible(due: Column, status: Column, recurrence: Column, today: Column) -> Column:
    """Whether an action can go into a calendar: it has a day or recurs, and has not passed."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return ~is_passed(due, today) & (F.coalesce(status, F.lit("")) != "passed") & (some(due) | some(recurrence))


def draft(uid: Column, title: Column, note: Column, date: Column, time: Column, alert: Column, rrule: Column | None = None, usual_note: str = "Reminder.") -> Column:
    """An event (EVENT): timed if a time hh:mm is given, else of the whole day; its alarm by choice."""
    at = F.left(F.coalesce(time, F.lit("")), F.lit(5))
    timed = at.rlike(r"^\d{2}:\d{2}$")
    day = F.left(F.coalesce(date, F.lit("")), F.lit(10))
    alarm = F.lit(USUAL_ALARM)
    for choice, trigger in ALARMS.items():
        alarm = F.when(alert == choice, trigger).otherwise(alarm)
    return F.struct(
        F.coalesce(F.nullif(uid, F.lit("")), F.lit("reminder")).alias("uid"), shorten(collapse(F.coalesce(title, F.lit("")))).alias("title"),
        shorten(collapse(F.coalesce(F.nullif(note, F.lit("")), F.lit(usual_note))), 80).alias("description"), F.when(timed, F.concat(day, F.lit("T"), at, F.lit(":00"))).otherwise(day).alias("start"),
        (~timed).alias("all_day"), alarm.alias("alarm"), (F.lit(None).cast("string") if rrule is None else rrule).alias("rrule"),
    )


def action_events(actions: Column, title: Column, alert: Column, today: Column, hash_of, single: bool = False) -> Column:
    """Events of the actions (text, due, status, recurrence) that can go into a calendar, at nine; a missing day is today.

    single: as when one is added by itself, a recurring action repeats every month.
    """
    kept = F.filter(actions, lambda a: eligible(a["due"], a["status"], a["recurrence"], today))
    name = "-act-" if single else "-act-all-"

    def event(a: Column, i: Column) -> Column:
        rule = F.when(F.coalesce(a["recurrence"], F.lit("")) != "", "FREQ=MONTHLY") if single else None
        day = F.coalesce(F.nullif(a["due"], F.lit("")), today.cast("string"))
        return draft(hash_of(F.concat(title, F.lit(name), i.cast("string"))), a["text"], F.lit(None).cast("string"), day, F.lit("09:00"), alert, rule)

    return F.transform(kept, event)


def dose_calendar(doses: Column, medicines: Column, title: Column, day: Column, alert: Column, uid: Column) -> Column:
    """Events of the selected doses (medicine, slot, time), daily as often as the medicine (duration_days) is taken."""

    def event(d: Column) -> Column:
        days = F.get(medicines, d["medicine"])["duration_days"]
        rule = F.when(days > 0, F.concat(F.lit("FREQ=DAILY;COUNT="), days.cast("string")))
        return draft(F.concat(uid, F.lit("-med-"), d["medicine"].cast("string"), F.lit("-"), d["slot"]), title, F.lit(None).cast("string"), day, d["time"], alert, rule)

    return F.transform(doses, event)


def calendar_file(events: Column, stamp: Column, producer: str, domain: str) -> Column:
    """A calendar file of events (EVENT): folded lines that end in CR and LF, alarms where an event has one."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""

    def lines(e: Column) -> Column:
        start = F.when(e["all_day"], F.concat(F.lit("DTSTART;VALUE=DATE:"), F.left(F.replace(e["start"], F.lit("-"), F.lit("")), F.lit(8)))).otherwise(F.concat(F.lit("DTSTART:"), F.regexp_replace(e["start"], "[-:]", "")))
        alarm = F.array(F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.concat(F.lit("DESCRIPTION:"), escaped(e["title"])), F.concat(F.lit("TRIGGER:"), e["alarm"]), F.lit("END:VALARM"))
        made = F.array(
            F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), e["uid"], F.lit(f"@{domain}")), F.concat(F.lit("DTSTAMP:"), stamp), start, F.concat(F.lit("SUMMARY:"), escaped(e["title"])),
            F.when(some(e["description"]), F.concat(F.lit("DESCRIPTION:"), escaped(e["description"]))), F.when(some(e["rrule"]), F.concat(F.lit("RRULE:"), e["rrule"])),
        )
        return F.concat(made, F.when(some(e["alarm"]), alarm).otherwise(F.array().cast("array<string>")), F.array(F.lit("END:VEVENT")))

    head = F.array(*map(F.lit, ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{producer}//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH"]))
    text = F.concat(head, F.flatten(F.transform(events, lines)), F.array(F.lit("END:VCALENDAR")))
    return F.concat(F.array_join(F.transform(F.filter(text, lambda x: x.isNotNull()), folded), "\r\n"), F.lit("\r\n"))


def dates_text(events: Column) -> Column:
    """Events as a plain list: a dot, title and start, the description in brackets."""
    line = lambda e: F.concat(F.lit("• "), e["title"], F.lit(": "), e["start"], F.when(F.coalesce(e["description"], F.lit("")) != "", F.concat(F.lit(" ("), e["description"], F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(events, line), "\n")


def _url(t: Column) -> Column:
    return F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))


def calendar_link(base: str, title: Column, start: Column, description: Column) -> Column:
    """A link that opens a calendar with the event of a whole day."""
    day = F.left(F.replace(start, F.lit("-"), F.lit("")), F.lit(8))
    details = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("&details="), _url(description))).otherwise("")
    return F.concat(F.lit(f"{base}?action=TEMPLATE&text="), _url(title), F.lit("&dates="), day, F.lit("/"), day, details)


def message_link(base: str, t: Column) -> Column:
    """A link that opens a message with a text."""
    return F.concat(F.lit(base), _url(t))
