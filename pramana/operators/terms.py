"""One list of terms in all texts: an automaton for each part of the list, of bounded size, sent to every task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import automaton, hits

#: Bytes of the terms of a part.
PART_BYTES = 4 << 20


def occurrences(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, term, places) for every text in which a term stands, however often: places may overlap.

    A list of terms that is larger than `part_bytes` is taken in parts, one scan of the
    texts for each; texts are not shuffled. Null texts and empty or null terms have no places.
    """
    wanted = terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    n_bytes = wanted.agg(F.sum(F.octet_length("term")).alias("n")).first()["n"] or 0
    parts, found = max(1, -(-n_bytes // part_bytes)), None
    schema = texts.select(F.col(key), F.lit("").alias("term"), F.lit(0).cast("long").alias("places")).schema

    def scan(part: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(tuple(part))
            for batch in batches:
                owner, numbers, counts = [], [], []
                for i, value in enumerate(batch.column(1)):
                    for number, n in sorted(Counter(x for _, _, x in hits(value.as_py() or "", machine)).items()):
                        owner.append(i)
                        numbers.append(part[number])
                        counts.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers, pa.string()), pa.array(counts, pa.int64())], schema.names)

        return texts.select(key, text).mapInArrow(run, schema)

    for number in range(parts):
        mine = [r["term"] for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == number).collect()]  # bounded by part_bytes
        if mine or found is None:
            some = scan(sorted(mine))
            found = some if found is None else found.unionByName(some)
    return found
