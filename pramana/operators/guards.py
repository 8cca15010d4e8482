"""Guards: numbers, terms and scripts must survive translation; spoken numbers must be in the document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, digit_runs, guard_form, numbers, protected_terms, script_share, term_form, terms_form


def _bare(d: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0"))


def translation_keeps_numbers(original: Column, translated: Column, strict: bool = False) -> Column:
    """Whether every run of digits of the original is in the translation, and money stays money.

    Each run uses up one equal run of the translation, or one without leading zeros;
    where none is left, it counts as kept inside any run. strict: only equal runs
    (leading zeros aside) count, however often. Texts without digits pass.
    """

    def used(x: Column) -> Column:
        """The fold over the runs: all kept so far, and the runs of the translation that are left."""

        def step(state: Column, d: Column) -> Column:
            same, bare = F.array_position(state["left"], d), F.array_position(state["left"], _bare(d))
            at = F.when(same > 0, same).otherwise(bare).cast("int")
            left = F.when(at > 0, F.concat(F.slice(state["left"], 1, at - 1), F.slice(state["left"], at + 1, F.size(state["left"])))).otherwise(state["left"])
            return F.struct((state["kept"] & ((at > 0) | F.exists(x["others"], lambda o: F.contains(o, d)))).alias("kept"), left.alias("left"))

        return F.aggregate(x["runs"], F.struct(F.lit(True).alias("kept"), x["others"].alias("left")), step, lambda state: state["kept"])

    def decide(x: Column) -> Column:
        kept = F.forall(x["runs"], lambda d: F.array_contains(x["others"], d) | F.array_contains(x["others"], _bare(d))) if strict else used(x)
        money = ~F.contains(x["a"], F.lit("₹")) | F.contains(x["b"], F.lit("₹"))
        return F.when(F.size(x["runs"]) == 0, True).when(x["empty"], False).otherwise(kept & money)

    runs = lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    forms = {"a": guard_form(original), "b": guard_form(translated), "empty": F.coalesce(translated, F.lit("")) == ""}
    return bind(lambda f: bind(decide, a=f["a"], b=f["b"], empty=f["empty"], runs=runs(f["a"]), others=runs(f["b"])), **forms)


def translation_keeps_terms(original: Column, translated: Column, terms: Column) -> Column:
    """Whether every protected term of the original is in the translation.

    Office words are no terms. Terms and texts are compared in one normal form, in
    any case, with white space collapsed. An empty translation fails, unless there
    are no terms or no original.
    """
    blank = lambda t: F.coalesce(t, F.lit("")) == ""

    def decide(x: Column) -> Column:
        kept = F.forall(x["terms"], lambda t: (t == "") | ~F.contains(x["a"], t) | F.contains(x["b"], t))
        return F.when(x["nothing"], True).when(x["empty"], False).otherwise(kept)

    nothing = (F.coalesce(F.size(terms), F.lit(0)) <= 0) | blank(original)
    return bind(decide, a=term_form(original), b=term_form(translated), terms=terms_form(protected_terms(terms)), nothing=nothing, empty=blank(translated))


def spoken_numbers_missing(spoken: Column, document: Column, allowed: Column | None = None) -> Column:
    """The numbers of a spoken summary that document and allowed texts lack (leading zeros do not matter), in order, repeats kept."""
    bare = lambda n: F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), n)

    def missing(x: Column) -> Column:
        return F.filter(x["said"], lambda n: ~(F.array_contains(x["known"], n) | F.array_contains(x["known"], bare(n))))

    expand = lambda k: F.concat(k, F.transform(k, bare), F.transform(k, lambda n: F.when(F.length(n) == 1, F.concat(F.lit("0"), n)).otherwise(n)))
    known = numbers(document)
    if allowed is not None:
        known = F.concat(known, numbers(F.array_join(allowed, " ")))
    return bind(missing, said=numbers(spoken), known=bind(lambda x: expand(x["known"]), known=known))


def script_passes(text: Column, lang: str) -> Column:
    """At least 40 % of letters in the script of the language."""
    return script_share(text, lang) >= 0.4


def first_failure(fields: DataFrame, *by: str) -> DataFrame:
    """Of rows (.., pos, field, kind, ok): the first that failed, by position, kind and field; null where all passed."""
    failed = F.struct("kind", "field")
    return fields.groupBy(*by).agg(F.min_by(failed, F.when(~F.col("ok"), F.struct("pos", "kind", "field"))).alias("f"), F.count_if(~F.col("ok")).alias("failures")).select(
        *by, F.when(F.col("failures") > 0, F.col("f.kind")).alias("kind"), F.when(F.col("failures") > 0, F.col("f.field")).alias("field"), "failures"
    )


def keyed_strings(results: DataFrame, arrays: list[str]) -> DataFrame:
    """Arrays of texts as rows (doc_id, key, value); keys are name_position_text."""
    parts = [
        results.select("doc_id", F.posexplode(name).alias("pos", "value")).select("doc_id", F.concat(F.lit(f"{name}_"), F.col("pos").cast("string"), F.lit("_text")).alias("key"), "value")
        for name in arrays
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stitched(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Keyed strings with their translation, or the original where there is none or it is blank."""
    other = translated.select("doc_id", "key", F.col("value").alias("other"))
    return original.join(other, ["doc_id", "key"], "left").select("doc_id", "key", F.when(F.trim("other") != "", F.col("other")).otherwise(F.col("value")).alias("value"))


def kept_label(original: Column, translated: Column) -> Column:
    """The translated label if it keeps the numbers, else the printed one."""
    other = F.coalesce(translated, F.lit(""))
    return F.when((other != "") & (other != original) & translation_keeps_numbers(original, translated), translated).otherwise(original)


#: Texts of a result that are translated: the name of the key, the column, and the field of its elements (none for plain texts).
SINGLE = [("title", "title"), ("report_title", "report_title"), ("unreadable_reason", "unreadable_reason"), ("glance_headline", "glance_headline"), ("spoken_summary", "spoken_summary")]
REPEATED = [
    ("summary_{i}", "summary", None), ("action_{i}_text", "actions", "text"), ("action_{i}_rule", "actions", "deadline_rule"), ("action_{i}_recurrence", "actions", "recurrence"), ("warning_{i}_text", "warnings", None),
    ("fact_{i}_text", "facts", None), ("conflict_{i}", "conflicts", None), ("glance_kv_{i}_label", "key_labels", None), ("place_{i}_label", "places", None), ("contact_{i}_label", "contacts", None),
    ("med_{i}_instruction", "instructions", None), ("form_{i}_name", "form_fields", "name"), ("form_{i}_instruction", "form_fields", "instruction"), ("section_{i}_heading", "sections", "heading"), ("part_{i}_title", "parts", "title"),
]
#: Texts one level deeper: the name of the key, the outer column, its inner list, and the field of the inner elements.
NESTED = [("section_{i}_value_{k}_label", "sections", "labels"), ("part_{i}_summary_{k}", "parts", "summary_lines"), ("part_{i}_section_{k}", "parts", "headings")]
#: Keys that are there even if their text is blank.
ALWAYS = r"^(title|summary_\d+|action_\d+_text|warning_\d+_text|fact_\d+_text|conflict_\d+|glance_headline|glance_kv_\d+_label|place_\d+_label|contact_\d+_label|part_\d+_summary_\d+)$"


def all_keyed_strings(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every translatable text of results as a row (doc_id, key, value): one pass, each list opened in place. Columns that `results` lacks give no keys."""
    pair = lambda name, value: F.struct(name.alias("key"), value.alias("value"))
    numbered = lambda pattern, i, k=None: F.concat(*(x for part in re.split(r"(\{[ik]\})", pattern) if part for x in [i.cast("string") if part == "{i}" else k.cast("string") if part == "{k}" else F.lit(part)]))
    lists = [F.array(pair(F.lit(name), F.col(c))) for name, c in SINGLE if c in results.columns]

    def opened(pattern: str, c: str, field: str | None) -> Column:
        return F.transform(c, lambda x, i: pair(numbered(pattern, i), x[field] if field else x))

    def opened_twice(pattern: str, c: str, inner: str) -> Column:
        return F.flatten(F.transform(c, lambda x, i: F.transform(x[inner], lambda y, k: pair(numbered(pattern, i, k), y))))

    lists += [opened(*row) for row in REPEATED if row[1] in results.columns and _has_field(results, row[1], row[2])]
    lists += [opened_twice(*row) for row in NESTED if row[1] in results.columns and _has_field(results, row[1], row[2])]
    all_ = F.concat(*(F.coalesce(x, F.array().cast("array<struct<key:string,value:string>>")) for x in lists))
    rows = results.select(key, F.explode(all_).alias("x")).select(key, "x.key", F.coalesce("x.value", F.lit("")).alias("value"))
    return rows.where(F.col("key").rlike(ALWAYS) | (F.col("value") != ""))


def _has_field(results: DataFrame, column: str, field: str | None) -> bool:
    return field is None or field in results.schema[column].dataType.elementType.fieldNames()


def guard_failures(original: DataFrame, translated: DataFrame, lengths: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first failure (kind, field) of each translated result; null where it passes.

    original, translated: keyed strings in reading order (doc_id, place, key, value);
    lengths: (doc_id, place, field, same) of lists that must be equally long; terms:
    (doc_id, terms), protected terms that must stay in the text as a whole.
    """
    other = translated.select(key, "key", F.col("value").alias("other"))
    numbers_ = original.join(other, [key, "key"], "left").select(key, F.col("place").alias("pos"), F.lit("digit").alias("kind"), F.col("key").alias("field"), translation_keeps_numbers(F.col("value"), F.col("other")).alias("ok"))
    sizes = lengths.select(key, F.col("place").alias("pos"), F.lit("other").alias("kind"), "field", F.col("same").alias("ok"))
    whole = lambda rows, c: rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), " ").alias(c))
    both = terms.join(whole(original, "a"), key).join(whole(translated, "b"), key, "left")
    kept = both.select(key, F.lit(1 << 20).alias("pos"), F.lit("protected_terms").alias("kind"), F.lit("protected_terms").alias("field"), translation_keeps_terms(F.col("a"), F.col("b"), F.col("terms")).alias("ok"))
    return first_failure(numbers_.unionByName(sizes).unionByName(kept), key)


def lists_keep_numbers(original: Column, translated: Column, cut: bool = False) -> Column:
    """Whether two lists of texts, place by place, keep the numbers; lists of different length fail, unless `cut` compares only what both have."""
    n = F.least(F.size(original), F.size(translated))
    same = F.forall(F.transform(F.slice(original, 1, n), lambda t, i: translation_keeps_numbers(t, F.get(translated, i))), lambda ok: ok)
    return same if cut else (F.size(original) == F.size(translated)) & same
