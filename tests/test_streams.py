"""Caches, built results, the limiter with timers, the saved page index."""

import datetime

import pytest
from pyspark.sql import functions as F

from pramana.operators import evidence
from pramana.plans.stream_queries import ROCKS
from pramana.streaming import builder, limiter
from pramana.streaming.caches import ContentCache


def test_cache_makes_only_what_is_missing(spark, tmp_path):
    asked = spark.createDataFrame([("a", "en"), ("a", "en"), ("b", "ta"), (None, "en"), ("c", None)], "digest string, lang string")
    cache, calls, day = ContentCache(spark, f"{tmp_path}/c", version=1, days=10), [], datetime.date(2026, 5, 1)

    def make(keys):
        calls.append(sorted(map(tuple, keys.collect())))
        return keys.withColumn("value", F.concat("digest", F.lit(len(calls))))

    assert cache.lookup(asked, day).where("value IS NOT NULL").count() == 0
    assert cache.fill(asked, make, day) == 2 and calls == [[("a", "en"), ("b", "ta")]]
    assert cache.fill(asked, make, day) == 0 and len(calls) == 1  # nothing is read for what is cached
    more = asked.unionByName(spark.createDataFrame([("b", "en")], "digest string, lang string"))
    assert cache.fill(more, make, day) == 1 and calls[-1] == [("b", "en")]
    found = sorted(map(tuple, cache.lookup(more, day).collect()), key=str)
    assert found == sorted([("a", "en", "a1"), ("a", "en", "a1"), ("b", "ta", "b1"), (None, "en", None), ("c", None, None), ("b", "en", "b2")], key=str)
    later = datetime.date(2026, 5, 11)
    assert cache.fill(asked, make, later) == 2  # all have expired
    assert {r["value"] for r in cache.lookup(asked, later).collect()} == {"a3", "b3", None}
    assert ContentCache(spark, f"{tmp_path}/c", version=2).lookup(asked, day).where("value IS NOT NULL").count() == 0
    sound = ContentCache(spark, f"{tmp_path}/audio", version=1, value_type="binary")
    assert sound.fill(asked, lambda k: k.withColumn("value", F.lit(b"\x00\x01")), day) == 2
    assert sound.lookup(asked, later).where("digest = 'a'").first()["value"] == b"\x00\x01"


def test_interrupted_builds_go_on(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "file string")
    body = lambda f, lang: '{"title": "%s %s", "n": "12"}' % (f, lang)
    rows = [(f, lang, body(f, lang)) for f in "abc" for lang in ("en", "ta", "hi")] + [("a", "en", "not an object"), ("a", "mr", "{}"), ("z", "en", body("z", "en"))]
    answers = spark.createDataFrame(rows, "file string, lang string, body string")
    facts = spark.createDataFrame([("a", "12"), ("a", "a en"), ("c", "13")], "file string, fact string")
    whole = builder.build(files, answers, facts, f"{tmp_path}/whole", ["ta", "en", "hi", "mr"])
    assert whole == {"en": 2, "ta": 2, "hi": 2, "mr": 0}
    seen = builder.built

    def dies(spark_, path, n=[]):  # noqa: B006
        n.append(1)
        if len(n) == 2:
            raise RuntimeError("killed")
        return seen(spark_, path)

    monkeypatch.setattr(builder, "built", dies)
    with pytest.raises(RuntimeError):
        builder.build(files, answers, facts, f"{tmp_path}/part", ["ta", "hi"])
    monkeypatch.setattr(builder, "built", seen)
    assert builder.build(files, answers, facts, f"{tmp_path}/part", ["ta", "hi"]) == {"en": 0, "ta": 2, "hi": 2}
    read = lambda p: sorted(map(tuple, spark.read.schema("value string, lang string, file string").text(p).collect()))
    assert read(f"{tmp_path}/part") == read(f"{tmp_path}/whole") and len(read(f"{tmp_path}/whole")) == 6
    assert sorted(p.name for p in (tmp_path / "whole" / "lang=en").iterdir()) == ["file=a", "file=b"]
    assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "whole" / "lang=en").iterdir())


def test_timers_clear_the_state(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        place = lambda n: f"{tmp_path}/in/{n}"
        schema = "endpoint string, ip long, id long, t double"
        spark.createDataFrame([("e", 1, i, 1000.0 + 10.0 * i) for i in range(6)], schema).coalesce(1).write.parquet(place("a"))
        calls = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("t"))
        run = lambda: limiter.limit_calls(calls, 2, 25, "ts", "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        state = lambda: spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "kept").load().count()
        run()
        found = {r["id"]: r["allowed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert found == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
        assert state() > 0
        spark.createDataFrame([("e", 2, 100, 5000.0)], schema).coalesce(1).write.parquet(place("b"))
        run()
        spark.createDataFrame([("e", 3, 101, 90000.0)], schema).coalesce(1).write.parquet(place("c"))
        run()
        left = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "kept").load().select("key.ip").distinct().collect()
        assert 1 not in {r["ip"] for r in left} and len(left) < 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_index_in_buckets_leaves_texts_where_they_are(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "Pay Rs. 1,200 before\n 30.11.2026"), (1, 2, "on the other page"), (2, 1, "alone"), (None, 1, "no document")], "doc_id long, page int, text string")
    rows = [(1, 0, "before 30.11.2026", "Rs. 1200", 1, None, "x"), (1, 1, "other page", "t", 1, False, "x"), (1, 2, "PAY ₹1200", "Rs. 99", 1, False, "x"), (1, 3, "before 30.11.2026 on the", "t", 9, False, "x"), (1, 4, " ", "t", 1, False, "x"), (1, 5, None, None, None, True, "x"), (3, 0, "alone", "t", 1, False, "x"), (None, 0, "no document", "t", 1, False, "x"), (2, 0, "alone", None, None, False, "x")]
    items = spark.createDataFrame(rows, "doc_id long, pos int, quote string, text string, page int, is_calculated boolean, pages string")
    index = evidence.write_index(pages, "page_index_of_tests", f"{tmp_path}/index", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.verify_by(items, index)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange" in plan.split("SortMergeJoin")[1].split("Scan")[0]
        labels = {(r["doc_id"], r["pos"]): r["evidence"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.columns == [*items.columns, "evidence"]
    m, c = "matched", "check_original"
    assert labels == {(1, 0): m, (1, 1): m, (1, 2): c, (1, 3): m, (1, 4): c, (1, 5): "calculated", (3, 0): c, (None, 0): c, (2, 0): m}
    assert {(r["doc_id"], r["pos"]): r["evidence"] for r in evidence.verify(items, pages).collect()} == labels
    spark.sql("DROP TABLE page_index_of_tests")


@pytest.mark.parametrize("by_timers", [False, True])
def test_callers_share_entries_of_the_state(spark, tmp_path, by_timers):
    schema = "endpoint string, ip long, id long, t double"
    big = 1 << 60  # no float holds these ids
    callers = [(e, ip) for e in ("e", "f", None) for ip in (*range(40), None, big + 1, big + 2)]
    rows = [(e, ip, None if n == 3 and ip == 5 else big + 100 * i + n, 1000.0 + 400.0 * batch + 9.0 * n + i % 7) for batch in (0, 1) for i, (e, ip) in enumerate(callers) for n in range(6)]
    for batch in (0, 1):
        spark.createDataFrame([r for r in rows if (r[3] >= 1300) == bool(batch)], schema).orderBy(F.desc("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    calls = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("t"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS if by_timers else before)
    try:
        judged = limiter.limit_calls(calls, 2, 25, "ts", "1 hour", buckets=4) if by_timers else limiter.limit_stream(calls, 2, 25, "ts", "1 hour", buckets=4)
        assert judged.columns == ["endpoint", "ip", "id", "t", "allowed"]
        judged.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/c")
        state = state.option("stateVarName", "kept").load() if by_timers else state.load()
        assert 0 < state.select("key").distinct().count() <= 4  # one for each of 129 callers before
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    wanted, held = [], {}
    for e, ip, i, t in sorted(rows, key=lambda r: (r[3], r[2] is not None, r[2] or 0)):
        kept = held[e, ip] = [x for x in held.get((e, ip), []) if t - x < 25]
        wanted.append((e, ip, i, t, len(kept) < 2))
        if len(kept) < 2:
            kept.append(t)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(wanted, key=str)
