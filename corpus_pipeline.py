"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet in the shared folder and reads it back for the next stage. All
but the last stage return the columns of documents. Only these change: rows that
language ID rejects and near-copies go, `lang` is the language found, repeated
bytes and secrets leave texts, n_chars follows the text.

Columns that `documents` has besides stay as they are, whatever their names. Rows
without an id stay in every stage. Rows that share an id are documents of their
own; equal rows are copies, of which near_dedup keeps one. An empty table gives
empty results. Texts are handled whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm import genetic_packing, language_mixture, secret_forest, simhash_anchors, suffix_columns
from pramana.llm.common import materialise, table, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a main language, and names it in `lang`; null texts, texts without a letter and even mixtures go."""
    return language_mixture.keep_identified(docs, language_mixture.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-copies."""
    return simhash_anchors.keep_one(docs).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 200-byte strings out of the texts; a character that is cut in two goes as a whole."""
    kept, spans = unused(docs, "kept", "spans")
    found = suffix_columns.strip(docs, kept=kept, spans=spans)
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(suffix_columns.as_text(kept))
    return _with_text(found, docs, text)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    model = secret_forest.train(secret_forest.labelled_findings(spark))
    return _with_text(secret_forest.redact(docs, model), docs, F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    cut = genetic_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return genetic_packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _with_text(found: DataFrame, docs: DataFrame, text) -> DataFrame:
    made = found.withColumn("text", text)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models and genetic packing can't be written as SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", *spent)
        spent = [docs]
    return docs
