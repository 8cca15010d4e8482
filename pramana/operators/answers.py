"""Answers about a document: context, numbers, evidence; spoken summaries; keyed payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import bind, collapse, digit_runs
from .guards import spoken_numbers_missing

MOST_CONTEXT = 8000


def short_list(items: Column, most: int) -> Column:
    """The first items that are not blank, white space collapsed."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda t: collapse(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.slice(kept, 1, most)


def guarded_numbers(answer: Column, facts: Column, context: Column, general: Column) -> Column:
    """(facts, invented): up to four facts whose numbers the context prints, and whether answer or facts hold others.

    General answers keep no fact with a number. Facts without label or value go.
    """
    bare = lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))

    def decide(x: Column) -> Column:
        printed = lambda runs: F.forall(runs, lambda d: F.array_contains(x["known"], d) | F.array_contains(x["known"], bare(d)))
        named = F.filter(x["facts"], lambda f: (F.trim(F.coalesce(f["label"], F.lit(""))) != "") & (F.trim(F.coalesce(f["value"], F.lit(""))) != ""))
        asked = F.filter(named, lambda f: ~(x["general"] & (F.size(f["runs"]) > 0)))
        fine = F.filter(asked, lambda f: printed(f["runs"]))
        # Facts behind the fourth good one are not looked at any more.
        fourth = F.get(F.filter(F.transform(asked, lambda f, i: F.when(printed(f["runs"]), i)), lambda i: i.isNotNull()), F.lit(3))
        seen = F.slice(asked, 1, F.coalesce(fourth, F.size(asked)))
        invented = ~printed(x["said"]) | F.exists(seen, lambda f: ~printed(f["runs"]))
        return F.struct(F.transform(F.slice(fine, 1, 4), lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"))).alias("facts"), invented.alias("invented"))

    with_runs = F.transform(facts, lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"), digit_runs(f["value"]).alias("runs")))
    return bind(decide, known=digit_runs(context), said=digit_runs(answer), facts=with_runs, general=F.coalesce(general, F.lit(False)))


def answer_evidence(answered_from: Column, not_found: Column, quote: Column, quoted: Column, has_source: Column, has_pages: Column, invented: Column) -> Column:
    """(answered_from, evidence) of an answer; `quoted` is the verdict on its quote."""
    made = lambda a, e: F.struct(a.alias("answered_from"), e.alias("evidence"))
    general = F.lower(F.trim(F.coalesce(answered_from, F.lit("")))) == "general"
    source = F.when(has_source | has_pages, "document").otherwise("summary")
    checked = lambda e: F.when(F.coalesce(invented, F.lit(False)), "check_original").otherwise(e)
    return (
        F.when(general, made(F.lit("general"), F.lit("none")))
        .when(F.coalesce(not_found, F.lit(False)), made(source, checked(F.lit("none"))))
        .when((F.coalesce(quote, F.lit("")) != "") & has_pages, made(F.lit("document"), checked(quoted)))
        .otherwise(made(source, checked(F.when(has_source | has_pages, "check_original").otherwise("none"))))
    )


HIDDEN_FIELDS = ("source_text", "protected_terms_rendered")
_CONTEXT = StructType([StructField("context", StringType()), StructField("kind", StringType())])


def _context(result: str | None) -> tuple[str, str]:
    try:
        found = json.loads(result or "{}")
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return (result or "")[:MOST_CONTEXT], ""
    kind = next((str(found[k]) for k in ("document_kind", "doc_type") if found.get(k)), "")
    kept = {k: v for k, v in found.items() if k not in HIDDEN_FIELDS}
    if isinstance(kept.get("parts"), list):
        kept["parts"] = [{k: v for k, v in p.items() if k != "source_text"} if isinstance(p, dict) else p for p in kept["parts"]]
    return json.dumps(kept, ensure_ascii=False)[:MOST_CONTEXT], kind


@F.pandas_udf(_CONTEXT)
def _contexts(results: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_context(r) for r in results], columns=["context", "kind"])


def ask_context(result: Column) -> Column:
    """(context, kind) of a result in JSON: without its source text and renderings, its parts without theirs, 8,000 characters; text that is no object as it is.

    Byte for byte as Python writes JSON: fields in their order, a blank behind commas and colons.
    """
    return _contexts(result)


def keyed_payload(raw: Column) -> Column:
    """The texts of a translation in JSON: those under `strings`, or of a flat object; values that are no text are left out."""
    def texts(json: Column) -> Column:
        fields = F.map_filter(F.from_json(json, "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
        return F.transform_values(fields, lambda k, v: v.cast("string"))

    wrapped, flat = texts(F.get_json_object(raw, "$.strings")), F.map_filter(texts(raw), lambda k, v: ~k.isin("strings", "protected_terms_rendered"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.when(F.size(wrapped) > 0, wrapped), flat, empty)


def spoken_summary(spoken: Column, lines: Column, title: Column, action: Column, due: Column, document: Column, allowed: Column) -> Column:
    """The spoken summary if all its numbers are printed or allowed, else the summary lines on that condition, else an English sentence."""
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")
    asked = F.trim(F.coalesce(spoken, F.lit(""))) != ""
    allowed_lines = F.when(asked, allowed).otherwise(F.array().cast("array<string>"))
    fine = lambda t, more: F.when((t != "") & (F.size(spoken_numbers_missing(t, document, more)) == 0), t)
    by = F.when(F.coalesce(due, F.lit("")) != "", F.concat(F.lit(" by "), due)).otherwise("")
    fallback = F.concat(F.lit("This is an official document regarding "), title, F.lit(". Please review the key details. "), F.coalesce(action, F.lit("")), by, F.lit("."))
    return F.coalesce(F.when(asked, fine(spoken, allowed)), fine(text, allowed_lines), fallback)
