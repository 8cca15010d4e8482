"""A store of results that streams write to: upserts, patches and deletes, the newest results of each owner.

Results lie in buckets of owners. A batch of changes rewrites the buckets it touches
into a folder of its own; then a manifest with the next number names the folder of
every bucket, and which batch of which writer it holds. Manifests are created, never
overwritten, so a version is there as a whole or not at all, and of two writers that
race for a number one starts again. A batch that a manifest holds already changes
nothing: a stream that is killed and starts again gives the same store.

Changes are rows (owner, id, seq, op, title, fields): `upsert` replaces a result,
`patch` puts some of its fields (those of a result that is not there are lost),
`delete` takes it away; later numbers count. After each batch an owner keeps the
`keep` results that were upserted last. Changes without an owner or id, and other
operations, do not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULTS = "owner string, id string, at long, title string, fields map<string,string>, bucket int"
CHANGES = "owner string, id string, seq long, op string, title string, fields map<string,string>"
TRIES = 20


class ResultStore:
    def __init__(self, spark: SparkSession, path: str, keep: int = 20, buckets: int = 16):
        self.spark, self.path, self.keep, self.buckets = spark, path.rstrip("/"), keep, buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifest(self) -> dict:
        """The newest manifest; an empty one of version 0 before any."""
        fs, place = self._fs(f"{self.path}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
        versions = [int(n) for n in names if n.isdigit()]
        if not versions:
            return {"version": 0, "writers": {}, "buckets": {}}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(place, str(max(versions))))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Whether this manifest is the one with its number."""
        fs, place = self._fs(f"{self.path}/manifest/{manifest['version']}")
        draft = self._fs(f"{self.path}/draft/{uuid.uuid4().hex}")[1]
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        fs.mkdirs(place.getParent())
        return not fs.exists(place) and fs.rename(draft, place)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All results, or those of some buckets, as of the newest version."""
        found = self.manifest()["buckets"]
        paths = [f"{self.path}/{p}" for b, p in found.items() if buckets is None or int(b) in buckets]
        # A folder that is named is read even if another batch commits meanwhile: folders are never written twice.
        return self.spark.read.schema(RESULTS).parquet(*paths) if paths else self.spark.createDataFrame([], RESULTS)

    def apply(self, changes: DataFrame, batch: int, writer: str = "batch") -> bool:
        """One batch of changes; False if the store holds it already."""
        rows = changes.where("owner IS NOT NULL AND id IS NOT NULL AND op IN ('upsert', 'patch', 'delete')").withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(self.buckets)).cast("int"))
        for _ in range(TRIES):
            now = self.manifest()
            if now["writers"].get(writer, -1) >= batch:
                return False
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # one row for each bucket at most
            folder = f"data/{uuid.uuid4().hex}"
            held = dict(now["buckets"])
            if touched:
                made = newest(folded(self.read(touched), rows), self.keep)
                made.withColumn("b", F.col("bucket")).repartition("b").write.partitionBy("b").parquet(f"{self.path}/{folder}")
                fs, place = self._fs(f"{self.path}/{folder}")
                there = {x.getPath().getName() for x in fs.listStatus(place)}
                for b in touched:
                    held.pop(str(b), None)
                    if f"b={b}" in there:
                        held[str(b)] = f"{folder}/b={b}"
            if self._commit({"version": now["version"] + 1, "writers": now["writers"] | {writer: batch}, "buckets": held}):
                return True
        raise RuntimeError("other writers were always faster")

    def sink(self, changes: DataFrame, checkpoint: str, writer: str = "stream") -> Callable[[], StreamingQuery]:
        """Starts a stream of changes into the store, up to the end of what there is."""
        run = lambda frame, batch: self.apply(frame, batch, writer) and None
        return lambda: changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self) -> int:
        """Deletes the folders and manifests that the newest version does not need; how many folders went. Not while others read or write."""
        now = self.manifest()
        used = {p.split("/")[1] for p in now["buckets"].values()}
        fs, data = self._fs(f"{self.path}/data")
        gone = [x.getPath() for x in fs.listStatus(data) if x.getPath().getName() not in used] if fs.exists(data) else []
        old = [x.getPath() for x in fs.listStatus(self._fs(f"{self.path}/manifest")[1]) if x.getPath().getName() != str(now["version"])] if now["version"] else []
        for place in [*gone, *old]:
            fs.delete(place, True)
        return len(gone)


def folded(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Results after changes (with bucket): grouped maxima and one join, whatever number of changes a result has."""
    key = ["owner", "id"]
    resets = changes.where("op <> 'patch'").groupBy(*key, "bucket").agg(F.max_by(F.struct("op", "seq", "title", "fields"), F.struct("seq", "op")).alias("reset"))
    base = results.join(resets, [*key, "bucket"], "full")
    new = F.col("reset").isNotNull()
    some = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    base = base.select(*key, "bucket", F.when(new, F.col("reset.seq")).otherwise(F.col("at")).alias("at"), F.when(new, F.col("reset.title")).otherwise(F.col("title")).alias("title"), some(F.when(new, F.col("reset.fields")).otherwise(F.col("fields"))).alias("fields"), F.coalesce(F.col("reset.op") == "delete", F.lit(False)).alias("gone"))
    base = base.where(~F.col("gone")).drop("gone")
    since = resets.select(*key, F.col("reset.seq").alias("since"))
    patches = changes.where("op = 'patch'").join(since, key, "left").where("since IS NULL OR seq > since")
    each = patches.select(*key, "seq", F.explode("fields").alias("field", "value")).groupBy(*key, "field").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    put = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("put"))  # one entry for each field
    joined = base.join(put, key, "left")
    kept = F.map_filter("fields", lambda k, v: ~F.coalesce(F.map_contains_key("put", k), F.lit(False)))
    return joined.select(*key, "at", "title", F.when(F.col("put").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "put")).alias("fields"), "bucket")


def newest(results: DataFrame, keep: int) -> DataFrame:
    """The `keep` results of each owner that were upserted last (ties: the greater id)."""
    order = Window.partitionBy("owner").orderBy(F.desc("at"), F.desc("id"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("rank")
