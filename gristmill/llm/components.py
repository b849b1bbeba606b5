"""Connected components of links between rows.

Links point from the larger node to the smaller. A gathering pass brings each node's smaller neighbours into one task,
which joins what is connected within its rows and keeps one link per node, to the smallest there: a spanning forest. So
about one link per node is left. A spreading pass does the same with the links of both directions, so that a node's
neighbours learn of its smallest one. A node with many links has them dealt out over salts; its smallest neighbour goes
to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ship, stable

#: A node's links are dealt out beyond this many and beyond twice a task's share.
HOT_LINKS = 256
#: Links in a task. Rounds are many and links are short, so a few full tasks are better than many with little to do.
LINKS_PER_TASK = 20_000
LEAST_TASKS = 4


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of the numbers below n reaches by links a, b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as (node, smallest node that it reaches in the task)."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks()
    coded = ends.dictionary_encode()
    nodes = coded.dictionary
    order = np.asarray(pa.compute.array_sort_indices(nodes))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[np.asarray(coded.indices)]
    root = _roots(codes[: table.num_rows], codes[table.num_rows :], len(order))
    node = np.flatnonzero(root != np.arange(len(root)))
    in_order = nodes.take(pa.array(order))
    yield from pa.table({"a": in_order.take(pa.array(node)), "b": in_order.take(pa.array(root[node]))}).to_batches()


def _tasks(n: int) -> int:
    return max(LEAST_TASKS, -(-n // LINKS_PER_TASK))


def _gathered(links: DataFrame, tasks: int) -> DataFrame:
    """Links after a gathering pass; there are at most as many as before."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stable(down.repartition("a").coalesce(tasks).mapInArrow(_forest, links.schema).distinct().coalesce(tasks))


def components(links: DataFrame) -> DataFrame:
    """Per linked node its root, the smallest node it reaches. links has columns a and b; returns node, root.

    Rounds go on until every node has one link, to its root; their number grows with the logarithm of the longest path.
    Nulls and self-links are left out. A task holds its share of the links.
    """
    ship(links.sparkSession)
    links = links.where(F.col("a") != F.col("b")).select("a", "b")
    pairs = _gathered(links, _tasks(links.count()))
    schema = pairs.schema
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not now["n"] or now == before:
            break
        before = now
        tasks = _tasks(now["n"])
        limit = max(HOT_LINKS, 4 * now["n"] // tasks)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least")).where(F.col("n") > limit)
        # Fewer than one hot node per task, since each has more than a task's share of the links.
        hot = F.broadcast(counted.select("a", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("salts"), "least"))
        salt = F.pmod(F.xxhash64("b"), F.coalesce(F.col("salts"), F.lit(1))).cast("int").alias("salt")
        dealt = both.join(hot.select("a", "salts"), "a", "left").select("a", "b", salt)
        least = hot.select("a", F.col("least").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        met = dealt.unionByName(least).repartition("a", "salt").coalesce(tasks).select("a", "b")
        pairs = _gathered(met.mapInArrow(_forest, schema), tasks)
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
