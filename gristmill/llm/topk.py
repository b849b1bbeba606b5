"""Exact search for the highest inner products by pivot-table elimination.

Every vector keeps its distances to a fixed number of pivots. For a query q and a vector x the triangle inequality
gives |q - x| >= max over the pivots of | |q - p| - |x - p| |, and with the lengths of q and x an upper bound of their
inner product. Candidates are evaluated in the order of that bound until it falls below the k-th best score.
Vectors and queries meet in blocks; a block of queries is sent to every block of vectors, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import ship, stable

PIVOTS = 24
#: Pivots are picked from a sample of so many vectors of each length, which also gives the first thresholds.
SAMPLE = 2_000
BLOCK = 4_096
QUERIES = 512
#: Blocks of vectors that share one copy of the queries.
BLOCKS_TOGETHER = 8


def whole_vectors(column: pa.Array, factor: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector takes part, and those vectors, as floor(factor * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) > 0
    rows = np.flatnonzero((sizes >= 0) & ~bad)
    flat = np.floor(factor * np.where(np.isfinite(flat), flat, 0.0))
    return rows, [flat[ends[i] - sizes[i] : ends[i]] for i in rows]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they hold them, else in 64-bit integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[-1] >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def far_points(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each as far as can be from those before it."""
    if not len(sample):
        return sample
    picked = [int(np.argmax((sample * sample).sum(axis=1)))]
    gap = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < n and gap.max() > 0:
        picked.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def search_block(q: np.ndarray, q_far: np.ndarray, x: np.ndarray, x_far: np.ndarray, ids: np.ndarray, same: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One query in one block: places and scores of its best k, with all that tie, and how many were evaluated.

    same: places to leave out; least: a score that k candidates are known to reach.
    """
    q_square, x_square = (q * q).sum(), (x * x).sum(axis=1)
    low = np.abs(x_far - q_far).max(axis=1, initial=0.0)
    # The slack covers rounding in the distances, so no bound is below the true score.
    bound = (q_square + x_square - low * low) / 2 + 1 + 1e-7 * (q_square + x_square)
    bound[same] = -np.inf
    order = np.flatnonzero(bound >= least) if least is not None else np.flatnonzero(bound > -np.inf)
    order = order[np.argsort(-bound[order], kind="stable")]
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 64
    while at < len(order):
        part = order[at : at + step]
        found = np.concatenate([found, part])
        scores = np.concatenate([scores, products(q[None, :], x[part])[0]])
        at, step = at + len(part), step * 2
        if len(scores) >= k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            found, scores = found[keep], scores[keep]
            if at < len(order) and bound[order[at]] < kth:
                break
    if len(scores) > k:
        best = np.lexsort((ids[found], -scores))[:k]
        found, scores = found[best], scores[best]
    return found, scores, at


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k highest inner products of floor(factor * x): query_id, rank (from 1), vec_id, score.

    A query meets every other row whose vector is as long as its own, also rows that repeat its id or vector; ties go
    to the smaller id, null ids last. Vectors that are null or hold null or non-finite components take no part. A query without candidates
    has no row. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    data = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # A sample of fixed size for each vector length, by the smallest hashes: the same in every run.
    ranked = data.where("v is not null").select("v", F.size("v").alias("n"), F.xxhash64("v").alias("h")).distinct()
    lengths = [r["n"] for r in ranked.groupBy("n").count().orderBy(F.desc("count"), "n").limit(64).collect()]
    samples: dict[int, np.ndarray] = {}
    for n in lengths:
        rows = ranked.where(F.col("n") == n).orderBy("h").limit(SAMPLE).select("v").toArrow().column("v")
        _, found = whole_vectors(rows, factor)
        samples[n] = np.array(found).reshape(len(found), n)
    pivots = {n: far_points(s, PIVOTS) for n, s in samples.items()}
    shared = spark.sparkContext.broadcast((samples, pivots))  # of fixed size

    block_schema = "n int, kind int, block long, ids binary, known binary, rows binary, data binary, far binary, least binary"
    names = [c.split(" ")[0] for c in block_schema.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, pivots = shared.value
        number = TaskContext.get().partitionId() << 33
        made = [number]
        held: dict[tuple[int, int], list[tuple]] = {}

        def block(n: int, kind: int) -> pa.RecordBatch:
            rows = held.pop((n, kind))
            x = np.array([r[2] for r in rows]).reshape(len(rows), n)
            far = distances(x, pivots[n]) if n in pivots and len(pivots[n]) else np.zeros((len(rows), 1))
            least = np.full(len(rows), np.iinfo(np.int64).min)
            if kind == 1 and n in samples and len(samples[n]) > k:  # the query itself may be in the sample
                s = products(x, samples[n])
                least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
            known = np.array([r[0] is not None for r in rows])
            made[0] += 1
            values = [n, kind, made[0], ids.tobytes(), known.tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), x.tobytes(), far.tobytes(), least.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        row = number
        for batch in batches:
            places, found = whole_vectors(batch.column("v"), factor)
            ids, queries = batch.column("id").to_pylist(), batch.column("is_query").to_pylist()
            for i, x in zip(places.tolist(), found, strict=True):
                for kind in (0, 1) if queries[i] else (0,):
                    own = held.setdefault((len(x), kind), [])
                    own.append((ids[i], row + i, x))
                    if len(own) == (QUERIES if kind else BLOCK):
                        yield block(len(x), kind)
            row += batch.num_rows
        for n, kind in list(held):
            yield block(n, kind)

    made = stable(data.mapInArrow(blocks, block_schema))
    groups = made.where("kind = 0").groupBy("n").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_TOGETHER).cast("int").alias("groups"))
    left = made.where("kind = 1").join(groups, "n").select(
        "n", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "data", "far", "least")]
    )
    right = made.where("kind = 0").join(groups, "n").select("n", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int").alias("grp"), "ids", "known", "rows", "data", "far")
    met = left.join(right, ["n", "grp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                known = np.frombuffer(r["known"], bool)
                x = np.frombuffer(r["data"]).reshape(len(ids), n)
                far = np.frombuffer(r["far"]).reshape(len(ids), -1)
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                q = np.frombuffer(r["q_data"]).reshape(len(q_ids), n)
                q_far, least = np.frombuffer(r["q_far"]).reshape(len(q_ids), -1), np.frombuffer(r["q_least"], np.int64)
                order = np.where(known, ids, np.iinfo(np.int64).max)
                out: list[tuple] = []
                for i in range(len(q)):
                    start = int(least[i]) if least[i] > np.iinfo(np.int64).min else None
                    places, scores, _ = search_block(q[i], q_far[i], x, far, order, np.flatnonzero(rows == q_rows[i]), start, k)
                    out += [(int(q_rows[i]), int(q_ids[i]), int(ids[j]) if known[j] else None, int(s)) for j, s in zip(places.tolist(), scores.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
