"""The store of results: batches, killed streams, races."""

import random

import pytest

from pramana.streaming.store import CHANGES, ResultStore


def plain(batches, keep):
    """The store in plain Python, batch by batch."""
    held = {}
    for batch in batches:
        for owner, i, seq, op, title, fields in sorted((b for b in batch if b[0] is not None and b[1] is not None), key=lambda b: b[2]):
            if op == "upsert":
                held[owner, i] = [seq, title, dict(fields or {})]
            elif op == "delete":
                held.pop((owner, i), None)
            elif op == "patch" and (owner, i) in held:
                held[owner, i][2].update(fields or {})
        for owner in {o for o, _ in held}:
            mine = sorted(((v[0], i) for (o, i), v in held.items() if o == owner), reverse=True)
            for _, i in mine[keep:]:
                del held[owner, i]
    return {k: (at, title, fields) for k, (at, title, fields) in held.items()}


def made(n, seed, start=0):
    rng = random.Random(seed)
    for seq in range(start, start + n):
        op = rng.choice(["upsert"] * 4 + ["patch"] * 5 + ["delete", "unknown"])
        fields = None if rng.random() < 0.1 else {rng.choice("abc"): rng.choice([str(seq), None])}
        yield (rng.choice(["o1", "o2", "o3", None]), rng.choice([*map(str, range(9)), None]), seq, op, None if rng.random() < 0.1 else f"t{seq}", fields)


def state(store):
    return {(r["owner"], r["id"]): (r["at"], r["title"], r["fields"]) for r in store.read().collect()}


def test_batches_and_repeated_ones(spark, tmp_path):
    store, batches = ResultStore(spark, f"{tmp_path}/s", keep=4, buckets=3), [list(made(60, 1)), [], list(made(60, 2, 60)), list(made(5, 3, 120))]
    assert store.read().count() == 0 and store.manifest()["version"] == 0
    for n, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, CHANGES)
        assert store.apply(frame, n)
        assert state(store) == plain(batches[: n + 1], 4)
        assert not store.apply(frame, n)  # once more: nothing changes
        assert store.manifest()["version"] == n + 1 and state(store) == plain(batches[: n + 1], 4)
    assert store.vacuum() > 0 and state(store) == plain(batches, 4)
    assert store.apply(spark.createDataFrame([("o9", "x", 1, "upsert", "new", {"a": "b"})], CHANGES), 0, "another writer")
    assert ("o9", "x") in state(store)


def test_a_killed_stream_goes_on(spark, tmp_path):
    batches = [list(made(40, s, 40 * s)) for s in range(4)]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    store = ResultStore(spark, f"{tmp_path}/s", keep=5, buckets=4)
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    whole, commit = store._commit, []

    def dies_before_the_second(manifest):
        commit.append(manifest["version"])
        if len(commit) == 2:
            raise RuntimeError("killed")
        return whole(manifest)

    store._commit = dies_before_the_second
    with pytest.raises(Exception, match="killed"):
        store.sink(stream(), f"{tmp_path}/c")().awaitTermination()
    assert store.manifest()["version"] == 1

    def dies_after(manifest):
        assert whole(manifest)
        raise RuntimeError("killed")

    store._commit = dies_after  # the version is there, the stream does not know
    with pytest.raises(Exception, match="killed"):
        store.sink(stream(), f"{tmp_path}/c")().awaitTermination()
    assert store.manifest()["version"] == 2
    store._commit = whole
    store.sink(stream(), f"{tmp_path}/c")().awaitTermination()
    assert store.manifest()["version"] == 4
    straight = ResultStore(spark, f"{tmp_path}/t", keep=5, buckets=4)
    straight.sink(stream(), f"{tmp_path}/d")().awaitTermination()
    assert state(store) == state(straight) and len(state(store)) > 5


def test_of_two_writers_none_is_lost(spark, tmp_path):
    store, other = ResultStore(spark, f"{tmp_path}/s"), ResultStore(spark, f"{tmp_path}/s")
    row = lambda i: spark.createDataFrame([("o", i, 1, "upsert", i, None)], CHANGES)
    whole, first = store._commit, []

    def late(manifest):
        if not first:
            first.append(other.apply(row("b"), 0, "other"))
        return whole(manifest)

    store._commit = late
    assert store.apply(row("a"), 0, "mine")
    assert set(state(store)) == {("o", "a"), ("o", "b")} and store.manifest()["version"] == 2


def test_the_store_as_a_data_source(spark, tmp_path):
    from pramana.sources.saved import SavedResults, bucket_of

    store = ResultStore(spark, f"{tmp_path}/s", keep=9, buckets=5)
    spark.dataSource.register(SavedResults)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda **more: spark.read.format("saved_results").options(path=f"{tmp_path}/s", buckets=5, **more).load()
        assert read().count() == 0
        rows = [(f"ö{o}", f"i{i}", 10 * o + i, "upsert", f"t{i}", {"k": str(i)}) for o in range(12) for i in range(9)]
        store.apply(spark.createDataFrame(rows, CHANGES), 0)
        assert {(r["owner"], r["id"]): (r["at"], r["title"], r["fields"]) for r in read().collect()} == state(store)
        assert all(bucket_of(r["owner"], 5) == r["bucket"] for r in store.read().select("owner", "bucket").distinct().collect())
        one = read().where("owner = 'ö3' AND id = 'i4'")
        assert one.rdd.getNumPartitions() == 1 and [r["at"] for r in one.collect()] == [34]
        newest = read(newest=2).where("owner = 'ö3'")
        assert newest.rdd.getNumPartitions() == 1 and [r["id"] for r in newest.collect()] == ["i8", "i7"]
        assert read(newest=2).where("id = 'i8'").count() == 12 and read(newest=2).where("id = 'i4'").count() == 0
        assert read().where("owner = 'nobody'").count() == 0 and read().where("at > 115").count() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
