"""Saved results as a data source of Spark: spark.read.format("saved_results").

Reads the newest version of a store (streaming.store): a partition for each bucket.
A filter on the owner is pushed down: it leaves the owner's bucket and reaches the
Parquet file; one on the id reaches the file. The option `newest` makes it a cursor
that gives that many results of each owner, from the last one upserted backwards.

Options: path (of the store), newest, buckets (as the store has them; 16). Register it with
spark.dataSource.register(SavedResults); filters need spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "owner string, id string, at long, title string, fields map<string,string>"
COLUMNS = ["owner", "id", "at", "title", "fields"]


def bucket_of(owner: str, buckets: int) -> int:
    """The bucket of an owner: Spark's xxhash64 of a text, modulo their number."""
    name = xxhash.xxh64_intdigest(owner.encode(), seed=42)
    return (name - (1 << 64) if name >> 63 else name) % buckets  # Spark's longs have a sign


class Bucket(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SavedResults(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SavedReader(self.options)


class SavedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.buckets = options["path"].rstrip("/"), int(options.get("buckets", 16))
        self.newest = int(options["newest"]) if options.get("newest") else None
        self.owner: str | None = None
        self.id: str | None = None

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality with an owner, and with an id where no newest ones are asked for; gives the rest back."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("owner",) and self.owner is None:
                self.owner = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("id",) and self.id is None and self.newest is None:
                self.id = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, root = self._files()
        there = files.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))
        versions = [int(x.base_name) for x in there if x.base_name.isdigit()]
        if not versions:
            return []
        with files.open_input_stream(f"{root}/manifest/{max(versions)}") as stream:
            held = json.loads(stream.read())["buckets"]
        wanted = None if self.owner is None else str(bucket_of(self.owner, self.buckets))
        return [Bucket(place) for number, place in sorted(held.items()) if wanted in (None, number)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there is no partition
            return
        files, root = self._files()
        test = None
        for column, value in (("owner", self.owner), ("id", self.id)):
            if value is not None:
                one = ds.field(column) == value
                test = one if test is None else test & one
        found = ds.dataset(f"{root}/{partition.path}", filesystem=files, format="parquet").to_table(columns=COLUMNS, filter=test)
        if self.newest is not None:
            order = pc.sort_indices(found, sort_keys=[("owner", "ascending"), ("at", "descending"), ("id", "descending")])
            found, seen, kept = found.take(order), {}, []
            for owner in found["owner"].to_pylist():
                seen[owner] = seen.get(owner, 0) + 1
                kept.append(seen[owner] <= self.newest)
            found = found.filter(pa.array(kept, pa.bool_()))
        yield from found.to_batches()
