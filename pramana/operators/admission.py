"""What may come in: files of a tray, contact values, feedback, photos and sample traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phone_digits

# Limits of a tray, an e-mail address, and what feedback may hold.
MOST_PHOTOS, MOST_PDFS, MOST_BYTES = 10, 5, 25 * 1024 * 1024
EMAIL = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}$"
FEEDBACK_LANGUAGES = ["en", "ta", "hi", "te", "ml", "kn", "mr", "bn", "or"]
FEEDBACK_KINDS = ["utility_bill", "telecom_bill", "tax_receipt", "insurance", "bank", "government_notice", "court_legal", "challan", "medical", "receipt", "agreement", "corporate", "other", "unknown"]
FEEDBACK_REASONS = ["wrong_date", "wrong_amount", "missed_action", "hard_to_understand", "other"]
VERSION = r"^[0-9A-Za-z._+-]{1,32}$"
HEIC_TYPES = ["image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence"]


def tray_code(files: DataFrame, by: str) -> DataFrame:
    """The verdict on each tray (is_pdf, bytes): photos or PDFs, not both; at most 10 photos; at most 5 PDFs and 25 MB of them."""
    pdf = F.col("is_pdf")
    sums = files.groupBy(by).agg(F.count_if(pdf).alias("pdfs"), F.count_if(~pdf).alias("photos"), F.sum(F.when(pdf, F.coalesce("bytes", F.lit(0)))).alias("bytes"))
    code = (
        F.when((F.col("pdfs") > 0) & (F.col("photos") > 0), "mixed").when(F.col("photos") > MOST_PHOTOS, "too_many_photos").when(F.col("pdfs") > MOST_PDFS, "too_many_pdfs")
        .when(F.col("bytes") > MOST_BYTES, "pdfs_too_large").when(F.col("pdfs") + F.col("photos") == 0, "empty").otherwise("ok")
    )
    return sums.select(by, code.alias("code"), ((code == "ok") & (F.col("photos").between(1, MOST_PHOTOS - 1))).alias("more_photos"))


def email_valid(t: Column) -> Column:
    """Whether a text is one e-mail address."""
    return F.coalesce(F.trim(t).rlike(EMAIL), F.lit(False))


def contact_valid(t: Column) -> Column:
    """Whether a text is an e-mail address or a phone number."""
    return email_valid(t) | phone_digits(t).isNotNull()


def sample_traffic(names: Column) -> Column:
    """Whether all files, one at least, are built-in samples."""
    return F.coalesce((F.size(names) > 0) & F.forall(names, lambda n: F.coalesce(n.startswith("sample-"), F.lit(False))), F.lit(False))


def heic_file(name: Column, mime: Column) -> Column:
    """Whether a file is a photo format that can't be read."""
    return F.lower(name).rlike(r"\.(heic|heif)$") | F.lower(F.coalesce(mime, F.lit(""))).isin(HEIC_TYPES)


def photo_file(name: Column, mime: Column) -> Column:
    """Whether a file is a photo, by type or name."""
    return F.coalesce(mime, F.lit("")).startswith("image/") | F.coalesce(name, F.lit("")).rlike(r"(?i)\.(jpe?g|png|heic|webp)$")


def photo_upload(files: Column) -> Column:
    """Whether all files (name, mime), one at least, are photos."""
    return F.coalesce((F.size(files) > 0) & F.forall(files, lambda f: photo_file(f["name"], f["mime"])), F.lit(False))


def asks_of_document(doc_id: Column, saved: Column, owner: Column, live: Column) -> Column:
    """The live turns if they belong to this document, else the saved ones; never another document's."""
    none = F.slice(saved, 1, 0)
    own = F.when((owner == doc_id) & (F.size(live) > 0), live)
    return F.when(F.coalesce(doc_id, F.lit("")) == "", none).otherwise(F.coalesce(own, saved, none))


def feedback_allowed(keys: Column, rating: Column, lang: Column, kind: Column, reasons: Column, sample_type: Column, version: Column, signed_in: Column, created: Column, now: Column) -> Column:
    """Whether a store takes a feedback row: known keys, languages, kinds and reasons (five at most, for bad ratings only), made now by a signed-in client."""
    base = ["rating", "lang", "docType", "sample", "appVersion", "createdAt"]
    only = lambda allowed: F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0
    known = F.size(F.array_except(reasons, F.array(*map(F.lit, FEEDBACK_REASONS)))) == 0
    common = signed_in & lang.isin(FEEDBACK_LANGUAGES) & kind.isin(FEEDBACK_KINDS) & (sample_type == "boolean") & version.rlike(VERSION) & (created == now)
    up, down = (rating == "up") & only(base), (rating == "down") & only([*base, "reasons"]) & reasons.isNotNull() & (F.size(reasons) <= 5) & known
    return F.coalesce(common, F.lit(False)) & (F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False)))
