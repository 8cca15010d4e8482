"""Evidence: does a quoted item, with its numbers, stand on the cited page?

Pages are normalised once, into an index with a row for each document. Items meet
it in one join by document, which keeps the verdict only; where the index is saved
in buckets, only the items are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, critical_tokens, evidence_form, guard_form
from ..sources.shared import unused


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id and the texts of its pages, in order, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def _all_in(tokens: Column, text: Column) -> Column:
    return F.forall(tokens, lambda t: (t == "") | F.contains(text, t))


def page_index(pages: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """doc_id, its pages (page, form) in the form of evidence, and the form of the whole text: what items are looked up in.

    Texts are shuffled once, by document. Written with `write_index`, they are not shuffled at all when items come.
    """
    form = lambda c: evidence_form(c, unicode_forms)
    each = pages.where("doc_id IS NOT NULL").select("doc_id", "page", "text", form(F.col("text")).alias("form"))  # no item meets a page without a document
    gathered = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "form"))).alias("pages"))
    whole = F.array_join(F.transform("pages", lambda p: p["text"]), " ")
    return gathered.select("doc_id", F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["form"].alias("form"))).alias("pages"), form(whole).alias("whole"))


def write_index(pages: DataFrame, name: str, path: str, buckets: int, unicode_forms: bool = True) -> DataFrame:
    """The page index as a saved table, bucketed by document: a join with items leaves its texts where they are."""
    page_index(pages, unicode_forms).write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).mode("overwrite").saveAsTable(name)
    return pages.sparkSession.table(name)


def verify_by(items: DataFrame, index: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """`items` (doc_id, pos, quote, text, page, is_calculated) with `evidence`, looked up in a page index.

    calculated; matched if the quote stands on its page (else in the document)
    and so does every amount, date and phone number of quote and item; otherwise
    check_original. Documents without pages give check_original. One join by
    document: the verdict is all that leaves it.
    """
    form = lambda c: evidence_form(c, unicode_forms)
    tokens = F.concat(critical_tokens(F.col("quote")), critical_tokens(F.col("text")))
    known, q, wanted, own, whole = unused(items, "known", "q", "tokens", "pages", "whole")
    asked = items.select(*items.columns, form(F.col("quote")).alias(q), F.split(form(F.array_join(tokens, "\u0001")), "\\s?\u0001\\s?").alias(wanted))
    there = index.select("doc_id", F.col("pages").alias(own), F.col("whole").alias(whole), F.lit(True).alias(known))
    joined = asked.join(there, "doc_id", "left")
    blank = F.col(known).isNull() | (F.trim(F.coalesce("quote", F.lit(""))) == "") | (F.col(q) == "")
    here = lambda p: (p["page"] == F.col("page")) & F.contains(p["form"], F.col(q))
    on_page = F.coalesce(F.exists(own, here), F.lit(False))
    fine = F.when(on_page, F.exists(own, lambda p: here(p) & _all_in(F.col(wanted), p["form"]))).otherwise(F.contains(whole, F.col(q)) & _all_in(F.col(wanted), F.col(whole)))
    label = F.when(F.col("is_calculated"), "calculated").when(blank, "check_original").when(fine, "matched").otherwise("check_original")
    return joined.select(*items.columns, label.alias("evidence"))


def verify(items: DataFrame, pages: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """`items` with `evidence`, looked up in pages (doc_id, page, text); see verify_by."""
    return verify_by(items, page_index(pages, unicode_forms), unicode_forms)


def summary(checked: DataFrame, *by: str) -> DataFrame:
    """Counts of matched, calculated and all other labels."""
    label = F.col("evidence")
    return checked.groupBy(*by).agg(
        F.count_if(label == "matched").alias("matched"),
        F.count_if(label == "calculated").alias("calculated"),
        F.count_if(label.isNull() | ~label.isin("matched", "calculated")).alias("check_original"),
    )


def lab_row(label: Column, value: Column, text: Column) -> Column:
    """matched if label (any case) and value (as printed) stand in the text."""
    fine = (F.trim(label) != "") & (F.trim(value) != "") & F.contains(text, F.trim(value)) & F.contains(F.lower(text), F.lower(F.trim(label)))
    return F.when(F.coalesce(fine, F.lit(False)), "matched").otherwise("check_original")


def place(address: Column, quote: Column, text: Column) -> Column:
    """matched if address or quote stands in the text (all three in the form of evidence)."""
    fine = ((address != "") & F.contains(text, address)) | ((quote != "") & F.contains(text, quote))
    return F.when(F.coalesce(fine, F.lit(False)), "matched").otherwise("check_original")


def glance(value: Column, kind: Column, text: Column, unicode_forms: bool = True) -> Column:
    """matched if a value stands in the text; an amount also by the digits of one of its tokens, a date also inside one."""

    forms = {"v": evidence_form(value, unicode_forms), "t": evidence_form(text, unicode_forms)}
    return bind(lambda x: glance_in(x["v"], value, kind, x["t"], x["tokens"]), **forms, tokens=critical_tokens(text))


def glance_in(form: Column, value: Column, kind: Column, text_form: Column, tokens: Column) -> Column:
    """The same for a text whose form and tokens are known."""
    digits = F.regexp_replace(guard_form(value), r"\D", "")
    amount = (kind == "amount") & bind(lambda x: (x["digits"] != "") & F.exists(tokens, lambda t: F.regexp_replace(guard_form(t), r"\D", "") == x["digits"]), digits=digits)
    day = (kind == "date") & (form != "") & F.exists(tokens, lambda t: F.contains(evidence_form(t, False), form))
    fine = ((form != "") & F.contains(text_form, form)) | amount | day
    return F.when(F.coalesce(fine, F.lit(False)), "matched").otherwise("check_original")


def part_glance(value: Column, text: Column) -> Column:
    """matched if the printed value stands in the text as it is."""
    return F.when(F.coalesce(F.contains(text, value), F.lit(False)), "matched").otherwise("check_original")


def quoted_lab_rows(rows: DataFrame, pages: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """rows (doc_id, pos, label, value, quote, page) with `evidence`: by quote and value where there is a quote, else by label and value on the page."""
    quoted = F.trim(F.coalesce("quote", F.lit(""))) != ""
    asked = rows.where(quoted).select(*rows.columns, F.coalesce("value", F.lit("")).alias("text"), F.lit(False).alias("is_calculated"))
    by_quote = verify(asked, pages, unicode_forms).select(*rows.columns, "evidence")
    plain = rows.where(~quoted).join(pages.select("doc_id", "page", F.col("text").alias("page_text")), ["doc_id", "page"], "left")
    return by_quote.unionByName(plain.select(*rows.columns, lab_row(F.col("label"), F.col("value"), F.col("page_text")).alias("evidence")))


def contact(value: Column, quote: Column, text: Column) -> Column:
    """matched if value or quote stands in the text, or seven digits or more do among its digits."""
    digits = F.regexp_replace(value, r"\D", "")
    run = (F.length(digits) >= 7) & F.contains(F.regexp_replace(text, r"\D", ""), digits)
    fine = ((value != "") & F.contains(text, value)) | ((quote != "") & F.contains(text, quote)) | run
    return F.when(F.coalesce(fine, F.lit(False)), "matched").otherwise("check_original")


def glance_amount(value: Column, tokens: Column) -> Column:
    """Whether an amount has the digits of one of the document's tokens."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return F.exists(tokens, lambda t: digits(t) == digits(value)) & (digits(value) != "")


def owning_part(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, page and the first part whose range covers it (-1 if none).

    Ranges are opened into pages no further than the document goes, so the match is an equality join.
    """
    ends = pages.groupBy("doc_id").agg(F.min("page").alias("least"), F.max("page").alias("most"))
    bounded = parts.join(ends, "doc_id").select("doc_id", "pos", F.greatest(F.least("first", "last"), "least").alias("a"), F.least(F.greatest("first", "last"), "most").alias("b"))
    covered = bounded.where("a <= b").select("doc_id", "pos", F.explode(F.sequence("a", "b")).alias("page"))
    first = covered.groupBy("doc_id", "page").agg(F.min("pos").alias("part"))
    return pages.select("doc_id", "page").join(first, ["doc_id", "page"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
