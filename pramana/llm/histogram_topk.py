"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers. Candidates are packed in blocks once and stay where
they lie; queries go to them, in groups of at most GROUP_BYTES, so what is sent
out is bounded and only histograms are shuffled. For a group, each round scores
everything and counts, for each query, the scores in the cells of its current
interval; a block reports only its highest cells, as far as k scores go (the k-th
of all is never below the k-th of a block). Counts are added up over all blocks,
and the interval shrinks to the cell that holds the k-th score, until a cell is
one value. A last pass keeps scores above it, and of those equal to it the
smallest ids that still count.

Vectors that are null, or hold null or non-finite components, and rows without an
id take no part. Fewer than k candidates: all. A repeated id is a candidate of its
own; as a query it counts once, with its least vector; rows with the query's id
are never its candidates. Vectors of different lengths are compared as if filled
up with zeros. Sums must be exact in doubles: vectors whose squared length reaches
2**53 raise an error. An empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise, shared_dir

CANDIDATE_BLOCK = 4096
GROUP_BYTES, TILE = 32 << 20, 256  # of the vectors of a group of queries, and queries scored at a time
CELLS = 1024
SCALE = 256


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and the vector `v` of floor(SCALE * x), for vectors without gaps."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return fine.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to `size` vectors of one partition: ids, values, and their width."""

    def block(ids: list[np.ndarray], rows: list[list[int]]) -> pa.RecordBatch:
        width = max((len(r) for r in rows), default=0)
        values = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            values[i, : len(r)] = r
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([values.tobytes()]), pa.array([width], pa.int32())], ["ids", "vs", "width"])

    ids, rows = [], []
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            rows.append(v)
            if len(ids) == size:
                yield block(ids, rows)
                ids, rows = [], []
    if ids:
        yield block(ids, rows)


def _unpack(ids: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(ids, np.int64)
    return at, np.frombuffer(values).reshape(len(at), width)


def _scores(qs: np.ndarray, q: np.ndarray, cs: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of queries and candidates; a query's own id gets none."""
    width = min(q.shape[1], c.shape[1])
    found = q[:, :width] @ c[:, :width].T
    found[qs[:, None] == cs[None]] = -np.inf
    return found


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest inner product of each query, ties to smaller ids."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, vector)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    asked = F.when(is_query(F.col("id")), F.col("id"))
    facts = whole.agg(F.max(length).alias("reach"), F.max(F.size("v")).alias("dim"), F.approx_count_distinct(asked).alias("n")).first()
    if not facts["n"]:
        return whole.where("false").selectExpr("id AS query_id", "0 AS rank", "id AS vec_id", "id AS score")
    reach = float(int(facts["reach"]) + 1)  # no score is larger (Cauchy-Schwarz)
    if reach >= 2**53:
        raise ValueError("components are too large for exact sums")
    dim = max(1, facts["dim"])
    n_groups = -(-facts["n"] * 11 // 10 * 8 * dim // group_bytes) or 1
    queries = whole.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_groups)))
    queries = materialise(queries, "queries")
    candidates = materialise(in_arrow(whole, lambda b: _pack(b, CANDIDATE_BLOCK), "ids binary, vs binary, width int"), "candidates")
    out = f"{shared_dir(spark)}/top-{uuid.uuid4().hex}"
    for part in range(n_groups):
        rows = queries.where(F.col("part") == part).orderBy("id").toPandas()  # bounded by `group_bytes`
        if len(rows):
            q = np.zeros((len(rows), dim))
            for i, v in enumerate(rows["v"]):
                q[i, : len(v)] = v
            _group(candidates, rows["id"].to_numpy(np.int64), q, k, reach).write.mode("append").parquet(out)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def _group(candidates: DataFrame, qs: np.ndarray, q: np.ndarray, k: int, reach: float) -> DataFrame:
    """The k best for the queries of one group."""
    context = candidates.sparkSession.sparkContext
    sent = context.broadcast((qs, q))
    width = 1.0
    while width * CELLS < 2 * reach + 1:
        width *= CELLS
    low, above = np.full(len(qs), -reach), np.zeros(len(qs), np.int64)
    while width >= 1:
        state = context.broadcast((low, above, width))

        def histogram(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            (qs, q), (low, above, w) = sent.value, state.value
            for batch in batches:
                for row in batch.to_pylist():
                    cs, c = _unpack(row["ids"], row["vs"], row["width"])
                    for at in range(0, len(qs), TILE):
                        scores, out = _scores(qs[at : at + TILE], q[at : at + TILE], cs, c), []
                        for i, mine in enumerate(scores, at):
                            mine = mine[(mine >= low[i]) & (mine < low[i] + w * CELLS)]
                            counts = np.bincount(np.floor((mine - low[i]) / w).astype(np.int64), minlength=CELLS)[::-1].cumsum()
                            need = k - above[i]
                            last = int(np.searchsorted(counts, need)) if counts[-1] >= need else CELLS - 1
                            each = np.diff(counts[: last + 1], prepend=0)
                            out += [(i, int(need), CELLS - 1 - int(j), int(each[j])) for j in np.flatnonzero(each)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["i", "need", "cell", "n"])

        sums = in_arrow(candidates, histogram, "i int, need long, cell int, n long").groupBy("i", "need", "cell").agg(F.sum("n").alias("n"))
        reached = F.sum("n").over(Window.partitionBy("i").orderBy(F.col("cell").desc()))
        spot = F.struct("cell", (F.col("reached") - F.col("n")).alias("before"))
        cut = sums.withColumn("reached", reached).groupBy("i").agg(F.coalesce(F.max(F.when(F.col("reached") >= F.col("need"), spot)), F.min(spot)).alias("x"))  # fewer than k candidates: keep all
        for r in cut.select("i", "x.cell", "x.before").collect():  # a row for each query of the group
            low[r["i"]] += r["cell"] * width
            above[r["i"]] += r["before"]
        width /= CELLS
    final = context.broadcast(low)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qs, q), low = sent.value, final.value
        for batch in batches:
            for row in batch.to_pylist():
                cs, c = _unpack(row["ids"], row["vs"], row["width"])
                for at in range(0, len(qs), TILE):
                    found: list[tuple[int, int, int]] = []
                    for i, mine in enumerate(_scores(qs[at : at + TILE], q[at : at + TILE], cs, c), at):
                        fine = np.flatnonzero(mine >= low[i])
                        best = fine[np.lexsort((cs[fine], -mine[fine]))[:k]]
                        found += [(int(qs[i]), int(cs[j]), int(mine[j])) for j in best]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in list(zip(*found, strict=True)) or [()] * 3], ["query_id", "vec_id", "score"])

    last = in_arrow(candidates, pick, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return last.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
