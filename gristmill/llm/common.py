"""Shared helpers: intermediate tables, texts as Arrow slices, words and their hashes in numpy."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: In the stages of the pipeline; a Python worker serves all of them and keeps what the largest took.
SHORT_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)

#: ASCII upper case to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
for _from, _to in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_from:_to] = True
#: Bytes of words between white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = 1 << max(n - 1, 1).bit_length()  # slices of one size need one array of about twice it
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by one polynomial over all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a slice, and the first word of each text (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    change = np.diff(inside)
    starts = change[:-1] == 1
    ends = change[1:] == -1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word is cut where a text ends
    starts[both] = True
    ends[both - 1] = True
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; those that cross texts are the caller's to drop."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    factor = _STEP
    for j in range(1, n):
        total += words[j : len(words) - n + 1 + j] * factor
        factor = np.uint64(int(factor) * int(_STEP) & (1 << 64) - 1)
    return mix(total)


def slices(column: pa.Array, most: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column: first row, row after the last, their UTF-8 bytes, offsets. Null is empty."""
    most = most or SLICE_BYTES
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(where, where[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, bytes_[where[first] : where[last]], where[first : last + 1] - where[first]
        first = last


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that copies of one are small against the batch that Spark sent."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def binary_rows(values: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless their search path has it."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="gristmill-")  # on the driver only: Spark sends the file to the executors
    name = f"{folder}/gristmill_package.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only an id and a text, under names of their own, whatever other columns there are."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[[^,]*\])?$", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))
    return context.getCheckpointDir().rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """The same rows from the folder in spark.checkpoint.dir, without their lineage.

    Several jobs may read them, and they outlive lost executors. Spark deletes the files with their
    last reader where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    tidy(df.sparkSession)
    return kept


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nobody reads any more, which jobs in many rounds leave.

    It does so once the driver has collected what referred to them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: for many rows cheaper than stable(), but nothing deletes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one operator reads again and again, deleted together once nothing does."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        """Only when every table made from these has been written, too."""
        jvm, context = self._spark.sparkContext._jvm, self._spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
        tidy(self._spark)


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column n says, without it; in runs, so that no long array is held."""
    runs = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / 65_536))).alias("_run"))
    here = F.least(F.col(n) - F.col("_run") * 65_536, F.lit(65_536)).cast("int")
    return runs.select("*", F.explode(F.sequence(F.lit(1), here)).alias("_copy")).drop(n, "_run", "_copy")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys next to each other in one partition, for a pass over sorted groups."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of rows that follow each other with equal keys. A group must be of bounded size."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for name in keys:
            column = batch.column(name)
            changed[1:] |= ~np.asarray(pa.compute.equal(column[1:], column[:-1]).fill_null(False))
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(name)[a].as_py() for name in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def labelled(docs: DataFrame, text: Column, label: Column) -> DataFrame:
    """label, h and n (hash and bytes) of the texts of docs: all that choosing a sample needs."""
    return docs.select(label.alias("label"), text_hash(text).alias("h"), F.octet_length(text).alias("n"))


def bounded_sample(rows: DataFrame, texts_: DataFrame, per_class: int, most_bytes: int) -> list[tuple[str, object]]:
    """Pairs (text, label) for fitting: at most per_class different texts of each label and most_bytes in all.

    rows has label, h and n as labelled() gives them, texts_ a column text; nulls are left out. Texts are chosen by
    their hash, so the sample is the same in every run, and copies count once. It is bounded by the two parameters
    and the number of labels. A text that no longer fits into its label's share of bytes is passed over; a label without
    any text that fits is learned from its shortest.
    """
    rows = rows.where(F.col("n").isNotNull() & F.col("label").isNotNull())
    shortest = {r["label"]: r["one"] for r in rows.groupBy("label").agg(F.min(F.struct("n", "h")).alias("one")).collect()}
    if not shortest:
        return []
    share = most_bytes / len(shortest)
    fitting = rows.where(F.col("n") <= share).select("label", "h", "n").distinct()
    sizes = {r["label"]: r["count"] for r in fitting.groupBy("label").count().collect()}
    chosen: dict[int, list] = {}
    for label in shortest.keys() - sizes.keys():
        chosen.setdefault(shortest[label]["h"], []).append(label)
    found = []
    if sizes:
        rate = F.create_map(*[x for label, n in sizes.items() for x in (F.lit(label), F.lit(min(1.0, 1.3 * per_class / n + 50 / n)))])
        uniform = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
        found = fitting.where(uniform < rate[F.col("label")]).collect()
    for label in sizes:
        total = count = 0
        for _, h, n in sorted((r["h"] % (1 << 64), r["h"], r["n"]) for r in found if r["label"] == label):
            if count < per_class and total + n <= share:  # one that does not fit is passed over
                total, count = total + n, count + 1
                chosen.setdefault(h, []).append(label)
    if not chosen:
        return []
    wanted = texts_.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
    # As many rows at most as the parameters allow.
    got = texts_.select("text", text_hash(F.col("text")).alias("h")).join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text"))
    return sorted(((r["text"], label) for r in got.collect() for label in chosen[r["h"]]), key=lambda p: (str(p[1]), p[0]))


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places from a table with one column `pos`, of 0 to 2^bits - 1.

    It arrives in pieces of 8 KB, 2^(bits - 16) of them, so its size depends on bits alone, not on the rows.
    """
    places = positions.select(F.shiftright("pos", 16).cast("int").alias("part"), F.col("pos").bitwiseAND(0xFFFF).cast("int").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, marks = None, np.zeros(1 << 16, bool)
        for batch in batches:
            parts, bits_ = batch.column("part").to_numpy(), batch.column("bit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts[a] != part:
                    if part is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "marks": [np.packbits(marks).tobytes()]})
                    part, marks = int(parts[a]), np.zeros(1 << 16, bool)
                marks[bits_[a:b]] = True
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "marks": [np.packbits(marks).tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in in_order(places.distinct(), "part").mapInArrow(run, "part int, marks binary").collect():
        out[r["part"] << 13 : (r["part"] + 1) << 13] |= np.frombuffer(r["marks"], np.uint8)
    return out


def marked(marks: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which places of a bitmap are set."""
    pos = pos.astype(np.int64)
    return (marks[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1


def split_rows(docs: DataFrame, marks: np.ndarray, bits: int, **more: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash `sub` (one of more) is not marked in a bitmap of 2^bits places, and those where it is.

    Both have the rows of docs whole, as the struct `row`, and the columns of more: no name of docs can clash.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])

    def where(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                sub = np.asarray(batch.column("sub")).view(np.uint64)
                yield batch.filter(pa.array(marked(shared.value, sub >> np.uint64(64 - bits)) == wanted))

        return run

    return own.mapInArrow(where(False), own.schema), own.mapInArrow(where(True), own.schema)


KEY_BITS = 25


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text are in dropped (doc_id, key of the text); null ids match null ids.

    Only rows that may be in dropped are shuffled, as a bitmap of fixed size tells.
    """
    sub = F.xxhash64("doc_id", "key")
    dropped = stable(dropped.select("doc_id", "key").distinct())
    marks = bitmap(dropped.select(F.shiftrightunsigned(sub, 64 - KEY_BITS).alias("pos")), KEY_BITS)
    key, own_id = text_key(docs[text_col].cast("string")), docs[id_col].cast("long")
    rest, maybe = split_rows(docs, marks, KEY_BITS, own_id=own_id, own_key=key, sub=F.xxhash64(own_id, key))
    kept = maybe.join(dropped, maybe["own_id"].eqNullSafe(dropped["doc_id"]) & (maybe["own_key"] == dropped["key"]), "left_anti")
    return rest.select("row.*").unionByName(kept.select("row.*"))
