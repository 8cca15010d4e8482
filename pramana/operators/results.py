"""Small decisions about a single result: glance, progress, chips, titles, answers, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import SHORT_MONTHS, is_passed
from ..functions.text import bind, critical_tokens, digit_runs, evidence_form
from . import evidence

# Span types, languages and reasons that payloads may hold.
SPAN_TYPES = ["person", "phone", "id", "address", "dob", "email"]
LANGUAGES = ["en", "hi", "ta", "te", "ml", "kn", "mr", "bn", "or"]
DOSE_TIMES = {"morning": "08:00", "afternoon": "13:00", "evening": "18:00", "night": "21:00", "bedtime": "22:00"}


def verbatim_spans(spans: Column, source: Column) -> Column:
    """Spans (text, type) of known types, two characters or more, copied from the source; each once, in order."""
    fine = lambda s: s["type"].isin(SPAN_TYPES) & (F.length(F.trim(s["text"])) >= 2) & F.contains(source, s["text"])
    return F.array_distinct(F.filter(F.coalesce(spans, F.array().cast("array<struct<text:string,type:string>>")), lambda s: F.coalesce(fine(s), F.lit(False))))


def split_of_three(a: Column) -> Column:
    """Whether the largest of three amounts is the sum of the others (to 1.5)."""
    s = F.array_sort(a)
    return (F.size(a) == 3) & (F.abs(F.get(s, 2) - F.get(s, 1) - F.get(s, 0)) < 1.5)


def split_shares(approved: Column, total: Column) -> Column:
    """(approved, rest) in whole per cent, halves up."""
    part = F.floor(approved / total * 100 + 0.5).cast("int")
    return F.when(total > 0, F.struct(part.alias("approved"), (100 - part).alias("rest")))


def glance(parts: Column, lab_values: Column, amounts: Column, kind: Column, upcoming: Column, texts: Column) -> Column:
    """The layout of the first screen."""
    n = F.size(amounts)
    bills = ["insurance", "utility_bill", "telecom_bill", "tax_receipt", "receipt"]
    return (
        F.when(parts > 1, "multi").when(lab_values > 0, "Dplus").when(kind.isin(bills) & split_of_three(amounts), "A").when(n == 1, "B")
        .when((n == 0) & upcoming, "C").when((n == 0) & texts.between(1, 4), "D").when(n.between(2, 3), "F").otherwise("E")
    )


#: Values of the first screen, and names asked for at a time.
MOST_VALUES, MOST_NAMES = 6, 12


def glance_values(values: Column, text: Column) -> Column:
    """The first values (label, value, kind) of the first screen with their evidence in the text; kinds that are not known are texts."""
    kind = lambda v: F.when(v["kind"].isin("amount", "date", "text"), v["kind"]).otherwise("text")
    first = F.slice(F.coalesce(values, F.array().cast("array<struct<label:string,value:string,kind:string>>")), 1, MOST_VALUES)
    made = lambda x: F.transform(x["first"], lambda v: F.struct(v["label"].alias("label"), v["value"].alias("value"), kind(v).alias("kind"), evidence.glance_in(evidence_form(v["value"], False), v["value"], kind(v), x["form"], x["tokens"]).alias("evidence")))
    return bind(made, first=first, form=evidence_form(text), tokens=critical_tokens(text))


def names_to_ask(missing: Column) -> Column:
    """The names whose renderings are asked for: the first ones, each on a line."""
    return F.array_join(F.transform(F.slice(missing, 1, MOST_NAMES), lambda n: F.concat(F.lit("- "), n)), "\n")


def expected_seconds(photos: Column, pages: Column) -> Column:
    """How long a reading is expected to take."""
    return F.when(photos > 0, F.greatest(photos, F.lit(1)) * 9).otherwise(F.greatest(pages, F.lit(1)) * 6 + 8)


def progress(elapsed: Column, expected: Column) -> Column:
    """(stage, percent): three bands, each slowing towards its end."""
    t = F.greatest(elapsed, F.lit(0.0)) / F.greatest(expected, F.lit(1.0))
    ease = lambda a, b, x: F.lit(float(a)) + (b - a) * (1 - F.pow(1 - F.least(x, F.lit(1.0)), F.lit(2.0)))
    made = lambda stage, percent: F.struct(F.lit(stage).alias("stage"), F.round(percent, 6).alias("percent"))
    return F.when(t >= 1, made("writing", F.lit(95.0))).when(t < 0.35, made("reading", ease(0, 35, t / 0.35))).when(t < 0.7, made("checking", ease(35, 70, (t - 0.35) / 0.35))).otherwise(made("writing", ease(70, 95, (t - 0.7) / 0.3)))


def short_issuer(t: Column) -> Column:
    """The issuer up to a comma or middle dot, 28 characters; blank for persons."""
    t = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    person = t.rlike(r"(?i)(?:^|\s)(?:mr|mrs|ms|dr|shri|smt)\.?(?:\s|$)")
    return F.when(person, "").otherwise(F.substring(F.trim(F.get(F.split(t, "[,·]"), F.lit(0))), 1, 28))


def short_day(iso: Column) -> Column:
    """As in 1 Oct; blank if it is no ISO date."""
    m = F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})", 2).try_cast("int")
    month = F.get(F.array(*map(F.lit, SHORT_MONTHS)), m - 1)
    return F.coalesce(F.concat(F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})", 3).try_cast("int").cast("string"), F.lit(" "), month), F.lit(""))


def default_name(kind: Column, issuer: Column, iso: Column) -> Column:
    """Kind, issuer and day, joined by middle dots, 60 characters."""
    bits = F.filter(F.array(F.trim(F.coalesce(kind, F.lit(""))), short_issuer(issuer), short_day(iso)), lambda x: x != "")
    return F.substring(F.array_join(bits, " · "), 1, 60)


def renamed(name: Column, fallback: Column) -> Column:
    """A new name of a document, 60 characters; a blank one gives the fallback."""
    cut = F.left(F.trim(F.coalesce(name, F.lit(""))), F.lit(60))
    return F.when(cut != "", cut).otherwise(F.trim(F.coalesce(fallback, F.lit(""))))


def visible_title(name: Column, title: Column) -> Column:
    """The name that was given to a document, 60 characters, else its title."""
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.when(own != "", F.left(own, F.lit(60))).otherwise(F.coalesce(title, F.lit("")))


def action_chip(evidence: Column, quote: Column, photo: Column) -> Column:
    """calculated, matched or check_original; none for photos without either."""
    return F.when(evidence.isin("calculated", "matched"), evidence).when(~photo & (F.coalesce(quote, F.lit("")) != ""), "check_original")


def presented_date(due: Column, status: Column, recurrence: Column, evidence: Column, quote: Column, photo: Column, today: Column) -> Column:
    """(passed, chip, in_calendar) of an action's date."""
    passed = F.coalesce(status == "passed", F.lit(False)) | is_passed(due, today)
    some = (F.coalesce(due, F.lit("")) != "") | (F.coalesce(recurrence, F.lit("")) != "")
    return F.struct(passed.alias("passed"), action_chip(evidence, quote, photo).alias("chip"), (~passed & some).alias("in_calendar"))


def headline(t: Column, most: int = 12) -> Column:
    """The first words of a headline."""
    return F.array_join(F.slice(F.split(F.trim(F.coalesce(t, F.lit(""))), r"\s+"), 1, most), " ")


PAGE_CHUNK = 5


def chunk_of(page: Column) -> Column:
    """The chunk of five pages that a page is read in, from 0."""
    return F.floor((page - 1) / PAGE_CHUNK).cast("int")


#: Kinds of items that the reference keeps from later chunks.
KEPT_FROM_ALL = ["section", "part"]


def merged_chunks(items: DataFrame, parity: bool = False) -> DataFrame:
    """Items (doc_id, chunk, pos, page, length) of the chunks of long documents as one list: pages shifted, by page (none first), chunk and place.

    parity: as the reference merges them. Of items (with `kind`) only sections and parts come from later
    chunks than a document's first; parts stay where there are two of them at least, in the order of chunks.
    """
    if parity:
        whole = Window.partitionBy("doc_id")
        items = items.withColumn("first_chunk", F.min("chunk").over(whole))
        items = items.where(F.col("kind").isin(KEPT_FROM_ALL) | (F.col("chunk") == F.col("first_chunk"))).drop("first_chunk")
        items = items.withColumn("n_parts", F.count_if(F.col("kind") == "part").over(whole)).where("kind <> 'part' OR n_parts >= 2").drop("n_parts")
    page = shifted_page(F.col("page"), F.col("chunk") * PAGE_CHUNK + 1, F.col("length"))
    rows = items.withColumn("page", page)
    order = [F.when(F.col("kind") == "part", 0).otherwise(F.coalesce("page", F.lit(0))), "chunk", "pos", F.coalesce("page", F.lit(0))] if parity else [F.coalesce("page", F.lit(0)), "chunk", "pos"]
    place = F.row_number().over(Window.partitionBy("doc_id", *(["kind"] if parity else [])).orderBy(*order))
    return rows.withColumn("place", place)


def feedback_reasons(rating: Column, reasons: Column) -> Column:
    """The reasons of a bad rating, each once, in order."""
    return F.when(rating == "down", F.array_distinct(reasons))


def shifted_page(page: Column, start: Column, length: Column) -> Column:
    """The page of a chunk's item in the whole document."""
    return F.when((page > 0) & (start > 1) & (page <= length), page + start - 1).otherwise(page)


def feedback_error(keys: Column, rating: Column, lang: Column, version: Column, reasons: Column, known: list[str]) -> Column:
    """The first rule that a feedback payload breaks; null if none."""
    allowed = F.array(*map(F.lit, ["rating", "lang", "docType", "reasons", "sample", "appVersion"]))
    return (
        F.when(F.size(F.array_except(keys, allowed)) > 0, "unexpected_field").when(~F.coalesce(rating.isin("up", "down"), F.lit(False)), "rating").when(~F.coalesce(lang.isin(LANGUAGES), F.lit(False)), "lang")
        .when(~version.rlike("^[0-9A-Za-z._+-]{1,32}$"), "version").when((rating == "up") & reasons.isNotNull(), "reasons_not_allowed").when(F.size(reasons) > 5, "too_many_reasons")
        .when(F.size(F.array_except(reasons, F.array(*map(F.lit, known)))) > 0, "reason")
    )


def answer_facts(facts: Column, context: Column, general: Column) -> Column:
    """Up to four facts (label, value) whose numbers the document prints; general answers keep none with numbers."""
    known = digit_runs(context)
    bare = lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))
    printed = lambda v: F.forall(digit_runs(v), lambda d: F.array_contains(known, d) | F.array_contains(known, bare(d)))
    fine = lambda f: (F.trim(f["label"]) != "") & (F.trim(f["value"]) != "") & F.when(general, F.size(digit_runs(f["value"])) == 0).otherwise(printed(f["value"]))
    return F.slice(F.filter(facts, fine), 1, 4)


def transcript(raw: Column) -> Column:
    """The text of a transcript in JSON, trimmed, 500 characters; blank if it can't be read."""
    return F.substring(F.trim(F.coalesce(F.get_json_object(raw, "$.text"), F.lit(""))), 1, 500)


def page_count(content: Column) -> Column:
    """Page objects named in the first 1.5 MB of a PDF."""
    return F.regexp_count(F.decode(F.substring(content, 1, 1_500_000), "ISO-8859-1"), F.lit(r"/Type\s*/Page(?!s)"))


def dose_events(slots: Column, times: Column) -> Column:
    """(medicine, slot, time) of the selected doses: keys are index-slot; times fall back to the slot's usual one."""
    usual = F.create_map(*(F.lit(x) for pair in DOSE_TIMES.items() for x in pair))
    chosen = F.filter(F.map_entries(slots), lambda e: e["value"])

    def event(e: Column) -> Column:
        parts = F.split(e["key"], "-")
        slot = F.get(parts, F.lit(1))
        return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("medicine"), slot.alias("slot"), F.coalesce(F.try_element_at(times, e["key"]), F.try_element_at(usual, slot), F.lit("08:00")).alias("time"))

    return F.transform(chosen, event)


def next_dose(today: Column, now_minutes: Column, time: Column) -> Column:
    """Today, or tomorrow if the time has passed."""
    at = F.split(time, ":")
    minutes = F.get(at, F.lit(0)).cast("int") * 60 + F.get(at, F.lit(1)).cast("int")
    return F.when(now_minutes >= minutes, F.date_add(today, 1)).otherwise(today)
