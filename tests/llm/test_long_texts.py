"""Very long texts through every operator and the pipeline, and secrets that are cut out by place."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pramana.llm import entry_queries, genetic_packing, secret_forest

RANKS = P.path("byte_bpe_50k.tiktoken")
M = 1_000_000
LONG = {1: " " * M, 2: "x", 3: "one " * (M // 4), 4: "a\n" + "\n" * M + "b", 5: "x" + " " * M + "y", 6: "the first line is short", 7: "w" * M, 8: " \t\n　" * (M // 4) + "z", 9: "plain words of a plain text"}


@pytest.fixture(scope="module")
def place(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("long"))
    rows = [(i, t, "en", "s", len(t)) for i, t in LONG.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in LONG], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one line"), (2, "plain x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("text", [" " * M, " " * 5 * M, "x" + " " * M + "y", "a\n" + "\n" * M + " b", " \t　" * 100_000 + "é", " " * 20_000 + "<|endoftext|>" + " " * 20_000 + " x", "\x1c" * 20_000 + " " * 20_000 + "\x1d", "w" * M, "1" * 300_000])
def test_long_runs_like_tokenizers(text):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert genetic_packing.encode_text(text, RANKS, P.PATTERN) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(set(entry_queries.queries()) - {"op8_topk"}))
def test_every_operator_takes_long_texts(spark, place, name):
    rows = entry_queries.queries()[name](spark, place).collect()
    if name == "op10_packing":
        plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        for i, t in LONG.items():
            mine = [r for r in rows if r["doc_id"] == i]
            assert sum(r["length"] for r in mine) == len(plain.encode(t, add_special_tokens=False).ids) + 1
    elif name not in ("op7_secret_scan", "op11_lexical_search"):
        assert sorted(r["doc_id"] for r in rows) == sorted(LONG)


def test_pipeline_takes_long_texts(spark, place):
    rows = corpus_pipeline.run(spark, place).collect()
    assert {r["doc_id"] for r in rows} >= {6, 9} and 1 not in {r["doc_id"] for r in rows}


def test_of_several_labels_toxic_counts(spark):
    from pramana.llm import toxicity_cnn

    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} words {i} here", "en") for i in range(120)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")
    more = labels.unionByName(labels.selectExpr("doc_id", "0 AS toxic")).unionByName(labels.limit(0).selectExpr("doc_id", "toxic"))
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity_cnn.score(docs, toxicity_cnn.fit(docs, x)).collect()) for x in (labels, more, more.repartition(3))]
    assert scores[0] == scores[1] == scores[2] and len({s for _, s in scores[0]}) > 2


def test_secrets_are_cut_by_place_and_row(spark):
    model = secret_forest.train(secret_forest.labelled_findings(spark))
    token, other = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "see commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff for the change"
    texts = [(1, 'password = "kestrel7!x" and later kestrel7!xylophone'), (None, f'the token = "{token}" is here'), (None, other), (4, None), (4, ""), (4, f'a token = "{token}" and then {other}'), (4, 'é password = "kestrel7!x" é 🙂')]
    docs = spark.createDataFrame([(i, t, "of", "hidden", "text_name") for i, t in texts], "doc_id long, text string, of string, hidden string, text_name string").repartition(2)
    rows = [(r["doc_id"], r["text"]) for r in secret_forest.redact(docs, model).collect()]
    found = secret_forest.scan(docs, model).where("is_secret").groupBy("before").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == len(texts) and len(found) >= 3
    assert (1, 'password = "[SECRET]" and later kestrel7!xylophone') in rows
    assert (None, 'the token = "[SECRET]" is here') in rows and (None, other) in rows
    assert (4, 'a token = "[SECRET]" and then see commit [SECRET] for the change') in rows and (4, 'é password = "[SECRET]" é 🙂') in rows
    assert (4, None) in rows and (4, "") in rows
    assert secret_forest.redact(docs, model).columns == docs.columns
