"""The pipeline's stages, one after the other, on a small table."""

import corpus_pipeline
import pytest

TEXT = "the house by the river was old and the people who lived there were kind to all that came by "


@pytest.fixture(scope="module")
def place(tmp_path_factory, spark):
    shared = " ".join(f"passage{i}" for i in range(60))
    texts = {
        1: TEXT + "first document about apples and pears and other fruit of the garden",
        2: TEXT + "first document about apples and pears and other fruit of the garden",
        3: "second " + shared + " end of the second",
        4: "fourth " + shared + " tail of the fourth, quite different",
        5: 'my note: token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and nothing else in here at all',
        6: None,
        7: "123 456 !!",
        8: "",
    }
    folder = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, place), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "packing" or docs.columns == names
    assert set(seen["language"]) == {1, 2, 3, 4, 5}
    assert set(seen["near_dedup"]) == {1, 3, 4, 5}
    assert seen["near_dedup"][1]["spans"] == "extra"
    assert "passage30" not in seen["repeats"][3]["text"] and seen["repeats"][3]["text"].startswith("second")
    assert seen["repeats"][1]["text"].startswith(TEXT) and seen["repeats"][4]["n_chars"] == len(seen["repeats"][4]["text"])
    assert "[SECRET]" in seen["secrets"][5]["text"] and "24be" not in seen["secrets"][5]["text"]
    assert set(seen["packing"]) == {1, 3, 4, 5}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, place).collect()} == {1, 3, 4, 5}


def test_clashing_names_and_an_empty_table(spark, place, tmp_path):
    docs = spark.read.parquet(f"{place}/documents.parquet").selectExpr("*", "'mine' AS kept", "1 AS tie", "2 AS k", "3 AS found", "4 AS data", "5 AS `values`")
    docs = docs.where("doc_id in (1, 2, 3, 4, 5)")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, place), name)
        assert {(r["spans"], r["kept"], r["tie"], r["k"], r["found"], r["data"], r["values"]) for r in docs.collect()} == {("extra", "mine", 1, 2, 3, 4, 5)}
    spark.read.parquet(f"{place}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_uses_the_language(spark, place):
    from pramana.llm import language_mixture

    texts = ["the cat and the dog were in the house with the old man", "le chat et le chien sont dans la maison avec une vieille dame"] * 60
    rows = [(i, t, ["en", "fr"][i % 2]) for i, t in enumerate(texts)] + [(900, texts[0], None), (901, texts[1], "en"), (902, "12 !?", "en"), (903, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in language_mixture.keep_identified(docs, language_mixture.fit(docs.where("doc_id < 900"))).collect()}
    assert kept[900] == "en" and kept[901] == "fr" and kept[0] == "en" and 902 not in kept and 903 not in kept
    model = language_mixture.fit(docs.where("doc_id < 900"))
    even = spark.createDataFrame([(1, " ".join(texts[:2] * 9), None)], "doc_id long, text string, lang string")
    assert language_mixture.keep_identified(even, model, least=0.9).count() == 0
