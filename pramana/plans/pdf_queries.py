"""Queries of PDF files: documents written as files of several kinds, and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import feed
from ..sources import pdf
from ..sources.pdf_writer import MAPPED, NESTED, PACKED, PLAIN, PROTECTED, pdf_of
from ..sources.shared import bounded_batches
from ..sources.tables import table
from .registry import query

#: Code points of a page; tasks for a partition of the documents.
PAGE, FILE_PARTS = 1500, 4
_STYLES = [PLAIN, PACKED, MAPPED, NESTED, PROTECTED]
# Characters outside of Windows-1252 can only be written with a map of characters.
_PAGES = f"SELECT doc_id, p, trim(substr(text, {PAGE} * (p - 1) + 1, {PAGE}), chr(10)) AS text FROM (SELECT doc_id, text, unnest(range(1, CAST(ceil(length(text) / {PAGE}.0) AS BIGINT) + 1)) AS p FROM documents)"
_LOCKED = "doc_id % 5 = 4 AND doc_id % 20 <> 4 AND doc_id % 3 <> 0"
_BROKEN = "doc_id % 11 = 7"


@F.pandas_udf(BinaryType())
def _file(pages: pd.Series, styles: pd.Series, passwords: pd.Series) -> pd.Series:
    return pd.Series([pdf_of(list(p), _STYLES[s], w) for p, s, w in zip(pages, styles, passwords, strict=True)])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content and given password: a file of each document, in five styles; one in eleven is cut off, and some are locked."""
    docs = bounded_batches(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.ceil(F.length("text") / PAGE).cast("int")
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.substring(F.col("text"), PAGE * (p - 1) + 1, F.lit(PAGE)))).otherwise(F.array().cast("array<string>"))
    style = F.when(F.col("text").rlike(r"[^\x00-\x7E\xA0-\xFF]"), 2).otherwise(F.pmod("doc_id", F.lit(5)).cast("int"))
    word = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("top"), "doc_id"))
    made = docs.select("doc_id", style.alias("style"), word.alias("word"), pages.alias("pages")).repartition(FILE_PARTS * docs.rdd.getNumPartitions(), "doc_id")  # files are dealt out as in a folder, in tasks of a bounded size
    made = made.select("doc_id", _file(F.col("pages"), F.col("style"), F.col("word")).alias("content"))
    cut = F.when(F.expr(_BROKEN), F.substring("content", F.lit(1), F.floor(F.length("content") * 0.6).cast("int"))).otherwise(F.col("content"))
    given = F.when(F.col("doc_id") % 20 == 4, F.concat(F.lit("top"), "doc_id")).when(F.col("doc_id") % 2 == 0, "wrong")
    return made.select("doc_id", F.col("doc_id").cast("string").alias("path"), cut.alias("content"), given.alias("password"))


_MAPPED = r"regexp_matches(text, '[^\x00-\x7E\x{00A0}-\x{00FF}]')"


@query(f"SELECT doc_id, CAST(p AS INTEGER) AS page, text FROM ({_PAGES}) WHERE NOT ({_BROKEN}) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE {_LOCKED} AND NOT coalesce({_MAPPED}, false))")
def pdf_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page of every file; files that are cut off or stay locked have none."""
    made = files(spark, sf_dir)
    return pdf.page_texts(made, F.col("password")).select(F.col("path").cast("long").alias("doc_id"), "page", "text")


@query(f"SELECT doc_id, CAST(CASE WHEN {_BROKEN} OR ({_LOCKED} AND NOT coalesce({_MAPPED}, false)) THEN 1 ELSE coalesce(ceil(length(text) / {PAGE}.0), 0) END AS INTEGER) AS pages FROM documents")
def pdf_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every file by its tree; 1 where it can't be read."""
    return pdf.page_counts(files(spark, sf_dir), F.col("password")).select(F.col("path").cast("long").alias("doc_id"), "pages")


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'bad_magic' WHEN {_BROKEN} THEN 'pdf_unopenable' ELSE 'ok' END AS verdict, "
    f"CASE WHEN doc_id % 13 = 0 OR {_BROKEN} THEN 'unreadable' WHEN doc_id % 5 <> 4 OR coalesce({_MAPPED}, false) THEN 'open' WHEN doc_id % 3 = 0 OR doc_id % 20 = 4 THEN 'opened' WHEN doc_id % 2 = 0 THEN 'password_wrong' ELSE 'password_required' END AS state FROM documents"
)
def pdf_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every file, and how it opens: by the empty password first, then by the given one."""
    made = files(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit(b"%PD"), F.substring("content", 6, 100))).otherwise(F.col("content")))
    made = made.withColumn("state", pdf.file_state(F.col("content"), F.col("password")))
    return made.select("doc_id", feed.opened_upload_kind(F.col("content"), F.lit("application/pdf"), F.col("state")).alias("verdict"), "state")
