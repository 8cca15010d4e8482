"""Sharing a result: spans from outside, masked results, share texts, and what is shared if a check fails."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.languages import HIDDEN, REMOVED, by_language, document_title
from ..functions.terms import replaced
from ..functions.text import bind, mask_email, mask_id
from .masking import birth_keys, masked_each
from .privacy import dates_and_amounts, mask_name, with_all_names_masked
from .results import SPAN_TYPES

PHONE_MASK = "**********"


def mask_span(text: Column, kind: Column, lang: Column) -> Column:
    """What stands for a span of a type."""
    return F.when(kind == "phone", PHONE_MASK).when(kind == "email", mask_email(text)).when(kind == "id", mask_id(text)).when(kind == "person", mask_name(text)).otherwise(by_language(HIDDEN, lang))


def with_spans_masked(t: Column, spans: Column, lang: Column) -> Column:
    """The text with every place of the given spans (text, type) masked, longer ones first; a place within another is left to that one.

    The text is walked once for all spans.
    """
    fine = F.filter(F.coalesce(spans, F.array().cast("array<struct<text:string,type:string>>")), lambda s: s["type"].isin(SPAN_TYPES) & (F.length(s["text"]) >= 2))
    return replaced(F.coalesce(t, F.lit("")), F.transform(fine, lambda s: s["text"]), lambda p: mask_span(p["term"], F.get(fine, p["which"])["type"], lang))


def masked_texts(texts: Column, terms: Column) -> Column:
    """Every text of a result masked alike: its names, all general rules, and each date equal to a birth date given in any of them."""
    return with_all_names_masked(masked_each(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), birth_keys(texts)), terms)


def redacted(summary: Column, actions: Column, facts: Column, terms: Column, fallback: Column, lang: Column) -> Column:
    """(summary, actions, facts, dates, amounts) of a result that is shared without personal details.

    fallback: names could not be told apart, so only actions, dates and amounts stay, with a note for a summary.
    """
    n, m = F.size(summary), F.size(actions)

    def decide(x: Column) -> Column:
        note = F.array(by_language(REMOVED, lang))
        none = F.array().cast("array<string>")
        kept = F.struct(F.slice(x["t"], 1, n).alias("summary"), F.slice(x["t"], n + 1, m).alias("actions"), F.slice(x["t"], n + m + 1, F.size(facts)).alias("facts"), none.alias("dates_and_amounts"))
        little = F.struct(note.alias("summary"), F.slice(x["t"], n + 1, m).alias("actions"), none.alias("facts"), x["d"].alias("dates_and_amounts"))
        return F.when(F.coalesce(fallback, F.lit(False)), little).otherwise(kept)

    all_ = F.concat(summary, actions, facts)
    return bind(decide, t=F.when(F.size(all_) > 0, masked_texts(all_, terms)).otherwise(all_), d=dates_and_amounts(all_))


#: Sections of a shared result in order: the field, its heading, and whether lines are numbered.
SECTIONS = [
    ("summary", "📌 In simple words:", False), ("actions", "✅ What you need to do:", True), ("warnings", "⚠️ Watch out:", False), ("facts", "📋 Key facts:", False), ("conflicts", "⚠️ Conflicting details:", False),
    ("medicines", "💊 Prescribed medicines:", False), ("places", "📍 Locations:", False), ("contacts", "📞 Contacts:", False), ("dates", "📅 Dates:", False), ("amounts", "💰 Amounts:", False),
]
PARTS = "📑 Documents:"


def share_text(title: Column, result: Column, fields: list[str], parts: Column | None = None) -> Column:
    """The text of a result whose lists of lines are the named fields of SECTIONS: sections in order, empty ones left out, parts (title, lines) at the end.

    Personal details are masked before, by `redacted` and `masked_texts`.
    """

    def section(name: str, head: str, numbered: bool) -> Column:
        lines = F.transform(result[name], lambda x, i: F.concat(F.concat((i + 1).cast("string"), F.lit(". ")) if numbered else F.lit("• "), x))
        return F.when(F.size(result[name]) > 0, F.concat(F.lit(f"\n\n{head}\n"), F.array_join(lines, "\n")))

    shown = [section(*s) for s in SECTIONS if s[0] in fields]
    if parts is not None:
        one = lambda p: F.concat(F.lit("\n--- "), p["title"], F.lit(" ---\n"), F.array_join(F.transform(p["lines"], lambda x: F.concat(F.lit("• "), x, F.lit("\n"))), ""))
        shown.append(F.when(F.size(parts) > 0, F.concat(F.lit(f"\n\n{PARTS}\n"), F.array_join(F.transform(parts, one), ""))))
    return F.concat_ws("", F.lit("📄 "), title, *shown)


def shared_title(title: Column, kind: Column, lang: Column, hide: Column) -> Column:
    """The title of a shared result; that of the document's type if personal details are hidden."""
    return F.when(hide, document_title(kind, lang)).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit("Document")))


def medicine_line(m: Column) -> Column:
    """A medicine (name, strength, instruction, frequency) as a line."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    more = F.coalesce(F.concat(F.lit(" — "), some(m["instruction"])), F.concat(F.lit(" ("), some(m["frequency"]), F.lit(")")), F.lit(""))
    return F.concat(F.concat_ws(" ", m["name"], some(m["strength"])), more)


def checked_share(checked: Column, spans: Column, text: Column, closed_text: Column, lang: Column) -> Column:
    """(text, closed): with the spans of the privacy check masked, or the closed text if that check failed."""
    return F.when(F.coalesce(checked, F.lit(False)), F.struct(with_spans_masked(text, spans, lang).alias("text"), F.lit(False).alias("closed"))).otherwise(F.struct(closed_text.alias("text"), F.lit(True).alias("closed")))


def check_key(doc_id: Column, lang: Column) -> Column:
    """The key under which the privacy check of a document in a language is kept."""
    return F.concat_ws("|", F.coalesce(doc_id, F.lit("")), F.coalesce(F.nullif(lang, F.lit("")), F.lit("en")), F.lit("hide"))


def _walk(value, visit):
    """A JSON value with every text put through `visit`, in the order of its fields."""
    if isinstance(value, str):
        return visit(value)
    if isinstance(value, list):
        return [_walk(v, visit) for v in value]
    return {k: _walk(v, visit) for k, v in value.items()} if isinstance(value, dict) else value


@F.pandas_udf(ArrayType(StringType()))
def _texts_of(results: pd.Series) -> pd.Series:
    def texts(result: str | None) -> list[str] | None:
        found: list[str] = []
        _walk(json.loads(result) if result else None, lambda t: found.append(t) or t)
        return found

    return results.map(texts)


@F.pandas_udf(StringType())
def _with_texts(results: pd.Series, texts: pd.Series) -> pd.Series:
    def put(result: str | None, new) -> str | None:
        if not result:
            return result
        left = iter(new)
        return json.dumps(_walk(json.loads(result), lambda t: next(left)), ensure_ascii=False)

    return pd.Series([put(r, t) for r, t in zip(results, texts, strict=True)])


def all_texts(result: Column) -> Column:
    """Every text of a nested result, whatever its fields, in their order."""
    return _texts_of(F.to_json(result))


def birth_keys_of(result: Column) -> Column:
    """Keys of the birth dates that any text of a nested result states."""
    return birth_keys(all_texts(result))


def masked_result(result: Column, schema: StructType, terms: Column) -> Column:
    """A nested result of a schema with every text masked: names, the general rules, and every date equal to a birth date stated anywhere in it."""
    as_json = F.to_json(result)
    texts = _texts_of(as_json)
    new = F.when(F.size(texts) > 0, masked_texts(texts, terms)).otherwise(texts)
    return F.from_json(_with_texts(as_json, new), schema)
