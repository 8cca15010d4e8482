"""The registered queries of the training-data operators: one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, genetic_packing, histogram_topk, language_mixture, lexical_scan, order_minhash, parity_join, periodic_runs, secret_forest, simhash_anchors, suffix_columns, token_codec, toxicity_cnn
from .common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_cnn.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    found = toxicity_cnn.score(docs, model)
    return found.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "flagged",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within 4 bits."""
    return simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to coded files and read back."""
    path = token_codec.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), token_codec.scratch(spark))
    return token_codec.digests(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.fit(docs.where(remainder("doc_id", 4) != 2))
    found = language_mixture.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and their decoded bytes, as digests."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's verdict; values as digests."""
    model = secret_forest.train(secret_forest.labelled_findings(spark))
    found = secret_forest.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "finding", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50."""
    return histogram_topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes under 200-byte strings that start at two places."""
    return suffix_columns.digests(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 2048 tokens."""
    cut = genetic_packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = genetic_packing.pack(cut)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return lexical_scan.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes of all documents, and the components of those whose sets of 3-word shingles are alike by 0.9."""
    return parity_join.near_sets(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten goes on from a word of its own with a period of its own (none without an id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.nullif(F.size("words"), F.lit(0)), F.col("g")
    found = found.withColumn("a", g % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return found.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of all documents with planted ones, as digests, and the longest of each."""
    return periodic_runs.digests(periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


OP8_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT r, doc_id, len(t) AS n, t FROM words WHERE len(t) > 0
), totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), counted AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
), scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (r), totals
  GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), flat AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.r AS a, b.r AS b FROM flat a JOIN flat b ON a.x = b.x AND a.r < b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (SELECT reach.a AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.b GROUP BY reach.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_token_codec": op3_token_codec,
        "op4_language_id": op4_language_id,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_order_minhash": op6_order_minhash,
        "op7_secret_scan": op7_secret_scan,
        "op8_topk": op8_topk,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_packing": op10_packing,
        "op11_lexical_search": op11_lexical_search,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator."""
    return {"op8_topk": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_jaccard_join": OP12_SQL}
