"""Near-duplicates by an inverted join of MinHash coordinates.

Texts of one shingle set are one class. A class posts itself under pairs of a coordinate and its value. Classes are
candidates if they agree in at least MATCHES of COORDINATES coordinates; the pairs are ordered by how often they
occur, and two candidates then share one of the first COORDINATES - MATCHES + 1 of each, so only those are posted.
Within a list, collisions are counted block by block, and pairs that can no longer reach the threshold are skipped.
Candidates form small clusters, in which all pairs are confirmed on the full shingle sets. Lists and clusters beyond
a block's size are dealt into blocks; rows of different blocks meet only if they are not yet connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import (
    LOWER, NOT_SPACE, SHORT_BYTES, bitmap, binary_rows, in_order, marked, mix, shingle_hashes, slices, sorted_groups, span_hashes, split_rows, stable, text_key, texts, without, word_spans,
)
from gristmill.llm.components import components

SHINGLE = 5
#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES = 64
#: Two sets of similarity 0.85 agree in fewer than 38 of 64 coordinates with a probability below 1.6e-7; such a link is missed.
MATCHES = 38
#: For other thresholds, a pair that just meets it is missed at most with this probability.
MISSED = 1e-7
#: Rows, and shingles in all, of a block.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 200_000
#: The order of postings comes from this many counters, however many postings there are. Any order gives the same links.
COUNTER_BITS = 16
FILTER_BITS = 25


def matches_for(percent: int) -> int:
    """The most agreeing coordinates that two sets of this similarity fall short of with probability MISSED at most."""
    p, missed = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        missed += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed > MISSED:
            return m
    return COORDINATES


_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray | None]:
    """Per text of a slice its distinct shingle hashes in order; None without words."""
    low = LOWER[data]
    starts, ends, at = word_spans(low, offsets, NOT_SPACE)
    words = span_hashes(low, starts, ends)
    shingles = shingle_hashes(words, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(shingles[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:  # fewer words: all of them as one
            yield mix(shingle_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield None


def signatures(docs: DataFrame) -> DataFrame:
    """For doc_id, text_key, text: doc_id, text_key, key (of the shingle set; null without words), n, signature."""
    schema = "doc_id long, text_key binary, key binary, n long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                sets = list(_sets(data, offsets))
                sizes = np.array([0 if s is None else len(s) for s in sets])
                full = sizes > 0
                found = np.zeros((len(sets), COORDINATES), np.uint32)
                if full.any():
                    every = np.concatenate([s for s in sets if s is not None])
                    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(COORDINATES):
                        found[full, k] = np.minimum.reduceat(every * _FACTORS[k] + _TERMS[k], begin) >> np.uint64(32)
                keys = [None if s is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")), pa.array(keys, pa.binary()), pa.array(sizes), binary_rows(found)],
                    ["doc_id", "text_key", "key", "n", "signature"],
                )

    return docs.mapInArrow(run, schema)


def _tokens(column: pa.Array) -> np.ndarray:
    """Coordinate-value pairs of signatures, as 64-bit numbers, one row per signature."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
    return mix(values | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def counters(classes: DataFrame) -> np.ndarray:
    """About how often pairs occur: 2^COUNTER_BITS counters, each for all pairs of one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_counter(_tokens(batch.column("signature"))).ravel(), minlength=1 << COUNTER_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in classes.select("signature").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """token, key: each class under the rarest pairs of its signature, as many as a candidate must share one of."""
    shared = classes.sparkSession.sparkContext.broadcast(counters(classes))  # of fixed size
    prefix = COORDINATES - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch.column("signature"))
            order = np.lexsort((tokens, shared.value[_counter(tokens)]), axis=1)[:, :prefix]
            rare = np.take_along_axis(tokens, order, 1).view(np.int64)
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(batch.num_rows), prefix)))
            yield pa.RecordBatch.from_arrays([pa.array(rare.ravel()), keys], ["token", "key"])

    return classes.select("key", "signature").mapInArrow(run, "token long, key binary")


Compare = Callable[[list[bytes], list[bytes] | None], np.ndarray]


def agreeing(matches: int = MATCHES) -> Compare:
    """Which signatures agree in so many coordinates: counted in two halves, the second only where it can still matter."""

    def compare(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        a = np.frombuffer(b"".join(left), np.uint32).reshape(-1, COORDINATES)
        b = a if right is None else np.frombuffer(b"".join(right), np.uint32).reshape(-1, COORDINATES)
        half = COORDINATES // 2
        count = np.zeros((len(a), len(b)), np.uint8)
        for k in range(half):
            count += a[:, k][:, None] == b[:, k][None, :]
        i, j = np.nonzero(count >= max(0, matches - (COORDINATES - half)))
        total = count[i, j] + (a[i, half:] == b[j, half:]).sum(axis=1)
        out = np.zeros(count.shape, bool)
        out[i, j] = total >= matches
        return out

    return compare


def similar(percent: int = PERCENT) -> Compare:
    """Which sets of 64-bit hashes have 100 * intersection >= percent * union."""

    def compare(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in (left if right is None else [*left, *right])]
        sizes = np.array([len(s) for s in sets], np.int64)
        _, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = n[which] > 1
        row = np.repeat(np.arange(len(sets)), sizes)[several]
        column = (np.cumsum(n > 1) - 1)[which][several]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        m = len(left)
        rows = slice(0, m)
        others = slice(0, m) if right is None else slice(m, len(sets))
        both = np.zeros((m, len(sets[others])), np.float64)
        width = 4096
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            part = slice(*np.searchsorted(column, [first, first + width]))
            block = np.zeros((len(sets), width), np.float32)
            block[row[part], column[part] - first] = 1
            both += block[rows] @ block[others].T
        inter = np.rint(both).astype(np.int64)
        return 100 * inter >= percent * (sizes[rows][:, None] + sizes[others][None, :] - inter)

    return compare


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        new = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


_LINKS = "a binary, b binary"


def _link_batch(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def linked(members: DataFrame, payload: DataFrame, compare: Compare) -> DataFrame:
    """Links that connect all rows of a group that compare() finds linked, directly or by others of any group.

    members: grp, key, size (what the row adds to a block); payload: key, value. Returns a, b: within a block a star
    per connected part, never all its pairs.
    """
    totals = members.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sized = totals.where("rows > 1").select("grp", blocks.alias("blocks"))
    dealt = stable(members.join(sized, "grp").select("grp", "key", "size", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, "grp", "block"):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_pylist()
            root = _local_roots(compare(group.column("value").to_pylist(), None))
            for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                a.append(keys[i])
                b.append(keys[root[i]])
            if len(a) > 5_000:
                yield _link_batch(a, b)
                a, b = [], []
        yield _link_batch(a, b)

    first = stable(in_order(dealt.select("grp", "block", "key").join(payload, "key"), "grp", "block").mapInArrow(inside, _LINKS).distinct())
    large = dealt.where("blocks > 1")
    if not large.limit(1).count():
        return first
    # Between blocks: rows outside a group's largest connected part against one another and against that part.
    roots = components(first)
    placed = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    by_root = placed.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    main = by_root.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("rows"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("roots"))
    parted = placed.drop("blocks", "block").join(main.where("roots > 1"), "grp").withColumn("rest", F.col("root") != F.col("main.root"))
    share = F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("rows") / BLOCK_ROWS) / F.col("rows")
    rest_blocks = F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("main.n")) * share)).cast("int")
    main_blocks = F.greatest(F.lit(1), F.ceil(F.col("main.n") * share)).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.when(F.col("rest"), rest_blocks).otherwise(main_blocks)).cast("int")
    counted = parted.select("grp", "key", "root", "rest", own.alias("own"), rest_blocks.alias("rest_blocks"), main_blocks.alias("main_blocks"))
    each_rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    each_main = F.sequence(F.lit(0), F.col("main_blocks") - 1)
    meeting = "array<struct<kind: int, x: int, y: int>>"

    def meet(kind: int, blocks, x, y):
        return F.transform(blocks, lambda j: F.struct(F.lit(kind).alias("kind"), x(j).alias("x"), y(j).alias("y")))

    with_rest = meet(0, each_rest, lambda j: F.least("own", j), lambda j: F.greatest("own", j))
    with_main = meet(1, each_main, lambda j: F.col("own"), lambda j: j)
    from_main = meet(1, each_rest, lambda j: j, lambda j: F.col("own"))
    meetings = F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(from_main).cast(meeting)
    pairs = counted.select("grp", "key", "root", "rest", "own", F.explode(meetings).alias("at")).select(
        "grp", "key", "root", "own", F.col("at.kind").alias("kind"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), "rest"
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "grp", "kind", "x", "y"):
            kind, x, y = (group.column(c)[0].as_py() for c in ("kind", "x", "y"))
            keys, values = group.column("key").to_pylist(), group.column("value").to_pylist()
            root = np.array([hash(r) for r in group.column("root").to_pylist()])
            rest, own = np.array(group.column("rest")), np.array(group.column("own"))
            left = np.flatnonzero(rest if kind else own == x)
            right = np.flatnonzero(~rest) if kind else np.flatnonzero(own == y)
            if not len(left) or not len(right):
                continue
            found = compare([values[i] for i in left], [values[i] for i in right])
            found &= root[left][:, None] != root[right][None, :]
            a, b = [], []
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                near = right[found[i]]
                _, one = np.unique(root[near], return_index=True)  # one link to each part is enough
                a += [keys[left[i]]] * len(one)
                b += [keys[j] for j in near[one].tolist()]
            if a:
                yield _link_batch(a, b)

    second = in_order(pairs.join(payload, "key"), "grp", "kind", "x", "y").mapInArrow(between, _LINKS)
    return first.unionByName(stable(second.distinct()))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, value: the whole shingle sets of the rows (doc_id, text_key) in wanted, one for each key.

    Of a text's copies only the row with the named id is worked on; rows that repeat an id and a text meet as one.
    """
    row = F.xxhash64("doc_id", "text_key")
    marks = bitmap(wanted.select(F.shiftrightunsigned(row, 64 - FILTER_BITS).alias("pos")), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(shared.value, np.asarray(batch.column("row")).view(np.uint64) >> np.uint64(64 - FILTER_BITS))))
            for first, last, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                values = [b"" if s is None else s.tobytes() for s in _sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), pa.array(values, pa.binary())], ["row", "value"])

    computed = docs.select("text", row.alias("row")).mapInArrow(run, "row long, value binary")
    once = computed.groupBy("row").agg(F.first("value").alias("value"))  # equal rows have one set
    return once.join(wanted.select("key", row.alias("row")), "row").select("key", "value")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id (the smallest doc_id it is linked to, by any path), kept.

    Words are parted by white space, A-Z in lower case. Null, empty and blank texts are linked with nothing and keep
    their own id. Rows with equal texts are linked. Null ids count as larger than all others: their component is that
    of the smallest id in it, or null, and they are not kept unless they stand alone. Rows that repeat an id and a
    text are answered each.
    """
    if matches is None:
        matches = MATCHES if percent == PERCENT else matches_for(percent)
    data = texts(docs, id_col, text_col, text_key(docs[text_col].cast("string")).alias("text_key"))
    rows = stable(signatures(data))
    classes = stable(
        rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min(F.struct("text_key", "doc_id", "signature")).alias("one"))
        .select("key", "rep", "n", "one.text_key", "one.doc_id", "one.signature")
    )
    posted = postings(classes, matches)
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    lists = lists.where("n > 1").groupBy("n", "x", "y").agg(F.min("token").alias("token"))  # equal lists once
    members = posted.join(lists.select("token"), "token").select(F.col("token").alias("grp"), "key", F.lit(1).cast("long").alias("size"))
    candidates = linked(members, classes.select("key", F.col("signature").alias("value")), agreeing(matches))
    clusters = stable(components(candidates))
    in_cluster = clusters.join(classes, clusters["node"] == classes["key"]).select(F.col("root").alias("grp"), "key", F.col("n").alias("size"), "text_key", "doc_id")
    sets = stable(full_sets(data, in_cluster.select("key", "doc_id", "text_key")))
    links = linked(in_cluster.select("grp", "key", "size"), sets, similar(percent))
    roots = components(links)
    reps = roots.join(classes, roots["node"] == classes["key"]).select("key", "root", "rep")
    smallest = reps.groupBy("root").agg(F.min("rep").alias("smallest"))
    of_class = classes.select("key", "rep").join(reps.join(smallest, "root").select("key", "smallest"), "key", "left")
    of_class = of_class.select("key", F.coalesce("smallest", "rep").alias("component"))
    answered = rows.select("doc_id", "text_key", "key", "n").join(of_class, "key", "left")
    return answered.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, with one document of each near-duplicate group: that of the smallest id.

    Of rows that repeat an id and a text, one stays, whatever their other columns are.
    """
    found = stable(near_duplicates(docs, percent, id_col=id_col, text_col=text_col))
    dropped = found.where(~F.col("kept")).select("doc_id", F.col("text_key").alias("key"))
    kept = without(docs, dropped, id_col, text_col)
    many = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = bitmap(many.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text_key"), 64 - FILTER_BITS).alias("pos")), FILTER_BITS)
    if not marks.any():
        return kept
    key, own_id = text_key(kept[text_col].cast("string")), kept[id_col].cast("long")
    once, maybe = split_rows(kept, marks, FILTER_BITS, own_id=own_id, own_key=key, sub=F.xxhash64(own_id, key))
    first = maybe.groupBy("own_id", "own_key").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(first.select("row.*"))
