"""Benchmark decontamination: a prefix-filtered set join between documents and windows of benchmark items.

Each window of an item is a set of shingles. They are ordered by rarity in the documents. To hold a whole window, a
document must hold the first shingle of that order, so a prefix of one is enough: documents meet the window only under
its rarest shingle. The shingle's place in the window then bounds where the window can lie, its length whether it fits
into the document, and the words at that place are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM, LOWER, SHORT_BYTES, bitmap, marked, repeated, shingle_hashes, slices, span_hashes, stable, text_key, texts, word_spans

WINDOW = 13
SHINGLE = 5
#: The filters that are sent to all tasks have 2^FILTER_BITS bits, however large the benchmark is.
FILTER_BITS = 25


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per item and shingle of its windows: item, window (its words), n_words, hash, place (in the window), width (words of the shingle)."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    schema = "item string, window string, n_words int, hash long, place int, width int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            for first, _, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                low = LOWER[data]
                starts, ends, at = word_spans(low, offsets, ALNUM)
                hashes = span_hashes(low, starts, ends)
                rows: list[tuple] = []
                for i in range(len(offsets) - 1):
                    own = slice(at[i], at[i + 1])
                    words = [low[s:e].tobytes().decode() for s, e in zip(starts[own], ends[own], strict=True)]
                    n = min(window, len(words))
                    if not n:
                        continue
                    width = min(shingle, n)
                    keys = shingle_hashes(hashes[own], width).view(np.int64)
                    for a in range(len(words) - n + 1):
                        joined = " ".join(words[a : a + n])
                        rows += [(names[first + i], joined, n, int(keys[a + p]), p, width) for p in range(n - width + 1)]
                for k in range(0, len(rows), 20_000):
                    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000], strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "window", "n_words", "hash", "place", "width"])

    return items.mapInArrow(run, schema)


def _hash_places(rows: DataFrame) -> DataFrame:
    return rows.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("pos"))


def _shingles(data: np.ndarray, offsets: np.ndarray, widths: list[int]):
    """Words of a slice, and per width the first words of the shingles that lie within one text, with their hashes."""
    low = LOWER[data]
    starts, ends, at = word_spans(low, offsets, ALNUM)
    hashes = span_hashes(low, starts, ends)
    text_end = np.repeat(at[1:], np.diff(at))
    found = []
    for width in widths:
        keys = shingle_hashes(hashes, width)
        inside = np.flatnonzero(np.arange(len(keys)) + width <= text_end[: len(keys)])
        found.append((width, inside, keys[inside]))
    return low, starts, ends, at, found


def occurrences(docs: DataFrame, shingles: DataFrame, marks: np.ndarray, widths: list[int]) -> DataFrame:
    """How often each shingle of the windows occurs in all documents: hash, n."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                *_, found = _shingles(data, offsets, widths)
                keys = np.concatenate([np.zeros(0, np.uint64), *[k[marked(shared.value, _places(k))] for _, _, k in found]])
                if len(keys):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["hash", "n"])

    counted = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return shingles.select("hash").distinct().join(counted, "hash", "left").select("hash", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Per window its rarest shingle: window, n_words, hash, place, width."""
    first = F.min(F.struct("n", "hash", "place", "n_words", "width")).alias("first")
    return shingles.join(counts, "hash").groupBy("window").agg(first).select("window", "first.n_words", "first.hash", "first.place", "first.width")


def probes(docs: DataFrame, marks: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """One row per document with its number of words, and one for each shingle that may begin a window's prefix.

    Columns doc_id, key, n_words (documents) or hash, at, before, context (shingles): the words from window - 1
    before the shingle to as many behind it, of which `before` come first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    schema = "doc_id long, key binary, n_words long, hash long, at long, before int, context string"
    names = ["doc_id", "key", "n_words", "hash", "at", "before", "context"]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for first, last, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                low, starts, ends, at, found = _shingles(data, offsets, widths)
                n = last - first
                nothing = [pa.nulls(n, t) for t in types[3:]]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), keys.slice(first, n), pa.array(np.diff(at)), *nothing], names)
                rows: list[tuple] = []
                for width, inside, hashes in found:
                    hit = np.flatnonzero(marked(shared.value, _places(hashes)))
                    text = np.searchsorted(at, inside[hit], "right") - 1
                    for w, h, i in zip(inside[hit].tolist(), hashes[hit].view(np.int64).tolist(), text.tolist(), strict=True):
                        a, b = max(at[i], w - window + 1), min(at[i + 1], w + width + window - 1)
                        context = " ".join(low[starts[j] : ends[j]].tobytes().decode() for j in range(a, b))
                        rows.append((ids[first + i].as_py(), keys[first + i].as_py(), None, h, w - int(at[i]), w - int(a), context))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.mapInArrow(run, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    one_in: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, key (of its text), n_words, n_hit, items, contaminated.

    n_hit counts words inside any occurrence of a window (window consecutive words of an item, or all words of a
    shorter one); items are the ids, as sorted strings, of items with such a window; contaminated if n_hit is above
    0 and at least one of one_in words is hit. Null and empty texts have no words. Rows that repeat a document are each
    answered. Items without words have no window; the windows of an item with a null id count, its id is not listed.
    """
    data = texts(docs, id_col, text_col, text_key(docs[text_col].cast("string")).alias("key"))
    all_shingles = stable(windows(benchmark, window, shingle, item_id_col, item_text_col))
    items = all_shingles.select("window", "item").distinct()
    distinct = all_shingles.drop("item").distinct()
    widths = sorted(r["width"] for r in all_shingles.select("width").distinct().collect())  # shingle at most
    counts = occurrences(data, distinct, bitmap(_hash_places(distinct), FILTER_BITS), widths)
    prefix = stable(prefixes(distinct, counts))
    found = stable(probes(data, bitmap(_hash_places(prefix), FILTER_BITS), widths, window))
    candidates = found.where("hash is not null").join(prefix.select("hash", "place", "width", "window", F.col("n_words").alias("length")), "hash")
    begin = F.col("before") - F.col("place")
    here = F.array_join(F.slice(F.split("context", " "), F.greatest(begin, F.lit(0)) + 1, F.col("length")), " ")
    hits = candidates.where((begin >= 0) & (here == F.col("window"))).select(
        "doc_id", "key", F.struct((F.col("at") - F.col("place")).alias("start"), F.col("length").cast("long").alias("n")).alias("span"), "window"
    )
    named = hits.select("doc_id", "key", "window").distinct().join(items, "window").select("doc_id", "key", "item").distinct()
    rows = found.where("hash is null").select("doc_id", "key", "n_words", F.lit(1).alias("copies"), F.lit(None).cast("struct<start: bigint, n: bigint>").alias("span"), F.lit(None).cast("string").alias("item"))
    empty = (F.lit(None).cast("long").alias("n_words"), F.lit(0).alias("copies"))
    everything = rows.unionByName(hits.select("doc_id", "key", *empty, "span", F.lit(None).cast("string").alias("item"))).unionByName(
        named.select("doc_id", "key", *empty, F.lit(None).cast("struct<start: bigint, n: bigint>").alias("span"), "item")
    )
    per_doc = everything.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def covered(a, s):
        end = s["start"] + s["n"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    counted = per_doc.withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(F.aggregate("spans", zero, covered)["n"]))
    flagged = counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    return repeated(flagged.select("doc_id", "key", "n_words", "n_hit", "items", "contaminated", "copies"), "copies")
