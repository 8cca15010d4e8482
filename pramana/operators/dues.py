"""Amounts due, paid amounts, reminders, medicines and activity of saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money_value, shorten
from .decoders import medicine_frequency
from .results import DOSE_TIMES, next_dose

# Labels of amounts to pay, of rents, and of amounts paid.
DUE = "(?i)total due|amount due|total payable|to pay|net payable|grand total|amount payable|premium|emi|fine|balance"
RENT = "(?i)rental|monthly rent|plan rent"
PAID = r"(?i)\b(paid|received)\b"
MOST_MEDICINES = 12


def _first(a: Column, keep) -> Column:
    return F.get(F.filter(a, keep), F.lit(0))["value"]


def amount_due(pairs: Column, fallbacks: list[Column]) -> Column:
    """The printed amount to pay: a labelled pair (label, value, kind), else the first fallback that is money, else any money but rents."""
    money = lambda p: F.coalesce(money_value(p["kind"], p["value"]), F.lit(False))
    labelled = _first(pairs, lambda p: p["label"].rlike(DUE) & ~p["label"].rlike(RENT) & money(p))
    other = [F.when(money_value(F.lit("amount"), f), f) for f in fallbacks]
    return F.coalesce(labelled, *other, _first(pairs, lambda p: ~p["label"].rlike(RENT) & money(p)), F.lit(""))


def due_day(profile_due: Column, next_instalment: Column, actions: Column) -> Column:
    """The day by which to pay: printed, of the next instalment, or of the first action (due, status) that has a day and has not passed."""
    open_ = F.filter(actions, lambda a: (F.coalesce(a["due"], F.lit("")) != "") & (F.coalesce(a["status"], F.lit("")) != "passed"))
    return F.coalesce(F.nullif(profile_due, F.lit("")), F.nullif(next_instalment, F.lit("")), F.get(open_, F.lit(0))["due"], F.lit(""))


def paid_amounts(pairs: Column) -> Column:
    """Values of pairs labelled as paid or received, each once, in order."""
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["label"].rlike(PAID) & (F.trim(p["value"]) != "")), lambda p: p["value"]))


def medicines(raw: Column, text: Column, photo: Column) -> Column:
    """The first twelve medicines (name, frequency, quote), blank names dropped after that, decoded and looked up in the text."""

    def one(m: Column) -> Column:
        found = (F.trim(m["quote"]) != "") & F.contains(text, F.trim(m["quote"])) | F.contains(F.lower(text), F.lower(F.trim(m["name"])))
        d = medicine_frequency(m["frequency"])
        return F.struct(F.trim(m["name"]).alias("name"), d["code"].alias("code"), d["slots"].alias("slots"), (d["code"] == "SOS").alias("as_needed"), F.when(~photo & found, "matched").otherwise("check_original").alias("evidence"))

    return F.transform(F.filter(F.slice(raw, 1, MOST_MEDICINES), lambda m: F.trim(m["name"]) != ""), one)


def reminder_rows(results: DataFrame, today: str) -> DataFrame:
    """id, pos, summary, date, status of the dated actions (text, due, status) of results (id, actions, translated).

    The translation of an action is the first with its date, else the one at its place, else its own text.
    """
    rows = results.select("id", "translated", F.posexplode("actions").alias("pos", "a"))
    day = F.substring(F.coalesce("a.due", F.lit("")), 1, 10)
    same = F.get(F.filter("translated", lambda t: t["due"] == F.col("a.due")), F.lit(0))["text"]
    text = F.coalesce(F.nullif(F.coalesce(same, F.get("translated", F.col("pos"))["text"]), F.lit("")), F.col("a.text"))
    summary = shorten(F.regexp_replace(text, r"\s+", " "))
    past = (day < today) | F.coalesce(F.col("a.status") == "passed", F.lit(False))
    rows = rows.select("id", "pos", summary.alias("summary"), day.alias("date"), F.when(past, "past").otherwise("upcoming").alias("status"))
    return rows.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("summary") != ""))


def activity_with(current: Column, patch: Column, has: Column) -> Column:
    """Activity (done, added, slots, times, durations, rating, lang, report) with a patch of the same fields; `has` names the fields that the patch states.

    A map that is stated replaces the old one; the three of medicines go together. A stated text or number counts even if it is null.
    """
    medicine = ["slots", "times", "durations"]
    stated = lambda name: F.array_contains(has, "medicine" if name in medicine else name)
    maps = [F.when(stated(n) & patch[n].isNotNull(), patch[n]).otherwise(F.when(stated(n), F.map_filter(current[n], lambda k, v: F.lit(False))).otherwise(current[n])).alias(n) for n in ("done", "added", *medicine)]
    texts = [F.when(stated(n), F.coalesce(patch[n], F.lit(""))).otherwise(F.coalesce(current[n], F.lit(""))).alias(n) for n in ("rating", "lang")]
    return F.struct(*maps, *texts, F.when(stated("report"), patch["report"]).otherwise(current["report"]).alias("report"))


def medicine_reminders(results: DataFrame, today: Column, now_minutes: Column) -> DataFrame:
    """id, key, summary, date, time of selected doses (results: id, names, slots, times); one row for all medicines where none is selected."""
    usual = F.create_map(*(F.lit(x) for pair in DOSE_TIMES.items() for x in pair))
    chosen = F.map_keys(F.map_filter("slots", lambda k, on: on))
    doses = results.select("id", "names", "times", F.explode_outer(chosen).alias("key"))
    part = F.split("key", "-")
    time = F.coalesce(F.try_element_at("times", F.col("key")), F.try_element_at(usual, F.get(part, F.lit(1))), F.lit("08:00"))
    all_ = F.array_join(F.transform(F.filter("names", lambda n: F.coalesce(n, F.lit("")) != ""), lambda n: F.concat(F.lit("Take "), n)), ", ")
    one = F.concat(F.lit("Take "), F.coalesce(F.get("names", F.get(part, F.lit(0)).try_cast("int")), F.lit("")))
    rows = doses.select(
        "id", F.coalesce("key", F.lit("added")).alias("key"), shorten(F.when(F.col("key").isNull(), all_).otherwise(one)).alias("summary"),
        F.when(F.col("key").isNull(), today).otherwise(next_dose(today, now_minutes, time)).alias("date"), F.when(F.col("key").isNull(), "").otherwise(time).alias("time"),
    )
    return rows.where("summary <> ''")


def merged_activity(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Activity (done map, rating) with patches: a map given replaces the old one; a rating counts if `has_rating`, null then blanks it."""
    other = patches.select(key, F.col("done").alias("__done"), F.col("rating").alias("__rating"), F.col("has_rating").alias("__has"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    return rows.join(other, key, "left").select(
        key, F.coalesce("__done", "done", empty).alias("done"), F.when(F.coalesce("__has", F.lit(False)), F.coalesce("__rating", F.lit(""))).otherwise(F.coalesce("rating", F.lit(""))).alias("rating")
    )


def closed_answer(answer: Column, note: Column) -> Column:
    """The answer with a note at its end, once."""
    return F.when((F.coalesce(note, F.lit("")) == "") | F.contains(answer, note), answer).otherwise(F.trim(F.concat_ws(" ", F.rtrim(F.coalesce(answer, F.lit(""))), note)))


def last_blocks(history: Column, n: int = 8, most: int = 4000) -> Column:
    """The last question blocks of a history, cut to `most` characters."""
    blocks = F.filter(F.transform(F.split(F.coalesce(history, F.lit("")), "\n(?=Q: )"), lambda b: F.trim(b)), lambda b: b != "")
    return F.substring(F.array_join(F.slice(blocks, F.greatest(F.size(blocks) - n + 1, F.lit(1)), n), "\n"), 1, most)


def follow_ups(items: Column) -> Column:
    """The first three suggestions that are not blank, eight words each."""
    words = F.transform(items, lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.slice(F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.array_join(F.slice(w, 1, 8), " ")), 1, 3)
