"""Relational work around saved results: retention, grouping, caps, patches, reminders, feedback, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, fold_evidence_digits
from ..sources.pdf import file_state
from .admission import contact_valid, email_valid


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def within_bytes(rows: DataFrame, by: list[str], order: list[Column], size: str, most: float, pass_over: bool = True) -> DataFrame:
    """The newest rows of each group as long as their sizes add up to at most `most`; a row larger than that is left out by itself, or (pass_over=False) ends its group's list."""
    rows = rows.where(F.col(size) <= most) if pass_over else rows
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__s", total).where(F.col("__s") <= most).drop("__s")


def first_seen(rows: DataFrame, by: list[str], same: str, order: str, n: int) -> DataFrame:
    """The first row of each value of `same`, then the first n of each group."""
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, same).orderBy(order))).where("__n = 1").drop("__n")
    return newest(once, by, [F.col(order), F.col(same)], n)


def consecutive_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of adjacent rows with equal values: by, run, value, first and last order, rows."""
    w = Window.partitionBy(by).orderBy(order)
    flag = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    numbered = rows.withColumn("__f", flag).withColumn("run", F.sum("__f").over(w).cast("long"))
    return numbered.groupBy(by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows"))


def feedback_counts(feedback: DataFrame, kinds: list[str]) -> DataFrame:
    """(what, value, n) over feedback (rating, lang, doc_type, reasons, sample): sample traffic left out, reasons of bad ratings only."""
    kept = feedback.where(~F.col("sample").eqNullSafe(True))
    kind = F.when(F.col("doc_type").isin(kinds), F.col("doc_type")).otherwise("unknown")
    reasons = F.when(F.col("rating") == "down", F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("what"), r.alias("value"))))
    pairs = F.concat(
        F.array(
            F.struct(F.lit("rating").alias("what"), F.coalesce("rating", F.lit("unknown")).alias("value")),
            F.struct(F.lit("language").alias("what"), F.coalesce("lang", F.lit("unknown")).alias("value")),
            F.struct(F.lit("doc_type").alias("what"), kind.alias("value")),
        ),
        F.coalesce(reasons, F.array().cast("array<struct<what:string,value:string>>")),
    )
    return kept.select(F.inline(pairs)).groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def summary_text(counts: DataFrame) -> DataFrame:
    """One line for each heading: its values and counts, in order."""
    return counts.groupBy("what").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ", ").alias("line"))


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`rows` with the fields of `patches` where these are not null."""
    other = patches.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return rows.join(other, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among `gone`."""
    return rows.join(gone.select(key), key, "left_anti")


def with_fallback(keys: DataFrame, words: DataFrame, lang: str, default: str = "en") -> DataFrame:
    """key and its word in a language, else in the default language, else the key itself."""
    own = words.where(F.col("lang") == lang).select("key", F.col("word").alias("own"))
    other = words.where(F.col("lang") == default).select("key", F.col("word").alias("other"))
    return keys.join(own, "key", "left").join(other, "key", "left").select("key", F.coalesce("own", "other", "key").alias("word"))


def upload_code(files: DataFrame, by: str) -> DataFrame:
    """The verdict on each upload (mime, bytes): one PDF of at most 20 MB, or 1 to 10 images of at most 25 MB, not mixed."""
    pdf, mega = F.col("mime") == "application/pdf", 1024 * 1024
    sums = files.groupBy(by).agg(F.count_if(pdf).alias("pdfs"), F.count_if(~pdf).alias("images"), F.sum("bytes").alias("bytes"))
    code = (
        F.when((F.col("pdfs") > 0) & (F.col("images") > 0), "mixed")
        .when(F.col("pdfs") > 1, "too_many_pdfs")
        .when((F.col("pdfs") == 1) & (F.col("bytes") > 20 * mega), "pdf_too_large")
        .when(F.col("images") > 10, "too_many_images")
        .when((F.col("images") > 0) & (F.col("bytes") > 25 * mega), "images_too_large")
        .otherwise("ok")
    )
    return sums.select(by, code.alias("code"))


def upload_kind(content: Column, mime: Column) -> Column:
    """ok, empty or bad_magic by the first bytes of a file."""
    head = F.hex(F.substring(content, 1, 1024))
    fits = (
        F.when(mime == "application/pdf", head.rlike("^(..)*255044462D"))
        .when(mime == "image/jpeg", head.startswith("FFD8FF"))
        .when(mime == "image/png", head.startswith("89504E470D0A1A0A"))
        .otherwise(True)
    )
    return F.when(F.length(content) == 0, "empty").when(fits, "ok").otherwise("bad_magic")


def opened_upload_kind(content: Column, mime: Column, state: Column | None = None) -> Column:
    """As upload_kind, and pdf_unopenable for a PDF without a page tree; a protected file counts as ok. state: of file_state, where it is known."""
    kind = upload_kind(content, mime)
    return F.when((kind == "ok") & (mime == "application/pdf") & ((file_state(content) if state is None else state) == "unreadable"), "pdf_unopenable").otherwise(kind)


def source_kind(pages: DataFrame, has_pdf: Column) -> DataFrame:
    """photo, scanned_pdf (under 50 characters) or text_pdf for each document."""
    n = F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", "")))
    return pages.groupBy("doc_id").agg(n.alias("n"), F.max(has_pdf).alias("pdf")).select("doc_id", F.when(~F.col("pdf"), "photo").when(F.col("n") < 50, "scanned_pdf").otherwise("text_pdf").alias("kind"))


def retry_after(calls: DataFrame, seconds: int) -> DataFrame:
    """Judged calls (endpoint, ip, id, t, allowed) with `wait`: whole seconds, one at least, until the oldest call that still counts has left the window; null for allowed ones."""
    kept = Window.partitionBy("endpoint", "ip").orderBy("t").rangeBetween(-seconds, 0)
    counted = F.when(F.col("allowed"), F.col("t"))
    alive = F.array_min(F.filter(F.collect_list(counted).over(kept), lambda t: F.col("t") - t < seconds))  # at most `limit` calls of a window are allowed
    return calls.withColumn("wait", F.when(~F.col("allowed"), F.greatest(F.lit(1), F.floor(seconds - (F.col("t") - alive))).cast("int")))


def owner_runs(pages: DataFrame) -> DataFrame:
    """Runs of pages (doc_id, page, part) that follow each other under one owner; pages without one (part below 0) belong to none and end a run."""
    owned = pages.where("part >= 0")
    run = F.col("page") - F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page"))
    return owned.withColumn("run", run).groupBy("doc_id", "part", "run").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("run")


def library_totals(rows: DataFrame, group: Column) -> DataFrame:
    """How many rows each filter group has, and all; rows without a group count in all only."""
    counts = rows.groupBy(group.alias("filter_group")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode(F.array(F.col("filter_group"), F.lit("all"))).alias("filter_group"), "n").where("filter_group IS NOT NULL").groupBy("filter_group").agg(F.sum("n").alias("n"))


def searched(rows: DataFrame, words: str, name: str, kind: str, kind_names: dict[str, str], group: Column | None = None, wanted: str = "all") -> DataFrame:
    """Rows of a filter group whose name, type or localised type holds the words, in any case."""
    localised = F.col(kind)
    for code, shown in kind_names.items():
        localised = F.when(F.col(kind) == code, shown).otherwise(localised)
    hay = F.lower(F.concat_ws("\n", F.col(name), localised, F.col(kind)))
    kept = rows if group is None or wanted == "all" else rows.where(group == wanted)
    return kept.where(F.contains(hay, F.lit(words.strip().lower())))


def distinct_places(places: DataFrame, most: int = 5) -> DataFrame:
    """The first places (doc_id, pos, address) of each document, each address once (white space and case aside); blank ones left out."""
    key = F.lower(collapse(F.coalesce("address", F.lit(""))))
    return first_seen(places.withColumn("__k", key).where("__k <> ''"), ["doc_id"], "__k", "pos", most).drop("__k")


def distinct_contacts(contacts: DataFrame, most: int = 6) -> DataFrame:
    """The first valid contacts (doc_id, pos, value) of each document, each once: phones by digits, addresses in any case."""
    trimmed = F.trim("value")
    key = F.when(email_valid(F.col("value")), F.lower(trimmed)).otherwise(F.regexp_replace(fold_evidence_digits(F.col("value")), r"\D", ""))
    kept = contacts.where(contact_valid(F.col("value"))).withColumn("__k", key).where("__k <> ''")
    return first_seen(kept, ["doc_id"], "__k", "pos", most).withColumn("value", trimmed).drop("__k")


def fair_calls(calls: DataFrame, limit: int, seconds: int) -> DataFrame:
    """calls (endpoint, ip, id, t) with `allowed`: at most `limit` allowed calls of each caller in any `seconds`.

    Rejected calls do not count, so each decision depends on those before it.
    A caller's calls are folded in order of time. Callers hold at most `limit`
    times between rows, and rows stream through sorted partitions.
    """
    from collections import deque
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, kept = None, deque()
        for frame in frames:
            out = []
            for e, ip, t in zip(frame["endpoint"], frame["ip"], frame["t"], strict=True):
                if (e, ip) != caller:
                    caller = (e, ip)
                    kept.clear()
                while kept and t - kept[0] >= seconds:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield frame.assign(allowed=out)

    rows = calls.select("endpoint", "ip", "id", F.col("t").cast("double").alias("t"))
    dealt = rows.repartition("endpoint", "ip").sortWithinPartitions("endpoint", "ip", "t", "id")
    return dealt.mapInPandas(run, rows.withColumn("allowed", F.lit(True)).schema)
