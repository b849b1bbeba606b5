"""Hierarchical residual packing of token sequences.

Partitions pack their own pieces best-fit and emit bins that are full or nearly so. The rest, as items of their
own, meet in ever fewer partitions and are packed best-fit again, until one partition is left or nothing more fits.
Only lengths and bin numbers move; a round's rows are the underfull bins of the round before.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, NOT_SPACE, SHORT_BYTES, slices, span_hashes, stable, texts, word_spans

CAPACITY = 2048
#: A bin with no more free places than this goes to no further round.
NEARLY_FULL = 3
#: A task packs so many pieces or bins at once, at most.
ITEMS_AT_ONCE = 400_000
#: So many partitions meet in one in the next round.
FAN_IN = 8
#: A Python worker remembers about so many pieces of texts; then it starts anew.
WORDS_KEPT = 800_000
_tokens: dict[str, WordTokens] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Numbers:
    """Numbers of 64-bit hashes in the order of their coming, in two arrays: a dict of as many takes four times as much."""

    def __init__(self, places: int = 1 << 16) -> None:
        self.keys = np.zeros(places, np.uint64)
        self.numbers = np.full(places, -1, np.int32)
        self._n = 0

    def __len__(self) -> int:
        return self._n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        last = len(self.keys) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            there = self.numbers[at[left]]
            same = (there >= 0) & (self.keys[at[left]] == hashes[left])
            out[left[same]] = there[same]
            left = left[(there >= 0) & ~same]
            at[left] = (at[left] + 1) & last
        return out

    def add(self, key: int) -> int:
        """The number of a hash that has none yet."""
        if 2 * self._n >= len(self.keys):
            full = np.flatnonzero(self.numbers >= 0)
            old = self.keys[full[np.argsort(self.numbers[full])]].tolist()
            self.__init__(2 * len(self.keys))
            for k in old:
                self.add(k)
        last = len(self.keys) - 1
        at = key & last
        while self.numbers[at] >= 0:
            at = (at + 1) & last
        self.keys[at], self.numbers[at] = key, self._n
        self._n += 1
        return self._n - 1


class WordTokens:
    """Ids of texts. Each different piece of a text goes through the tokenizer once and is remembered by its hash.

    For a tokenizer that drops white space and splits there, lowers case, and then parts letters from other signs, as
    word_bpe_49k does. Words of letters up to U+00FF and ASCII punctuation without apostrophes are parted here, and
    each part goes to the tokenizer's model; all other words pass the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.character = byte_characters()
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, key: int, piece: bytes, hard: bool) -> int:
        if hard:
            ids = self.whole.encode(piece.decode(), add_special_tokens=False).ids
        else:
            shown = piece.decode() if piece.isascii() else "".join(map(self.character.__getitem__, piece))
            ids = [t.id for t in self.model.tokenize(shown)]
        n = len(self.known)
        if n == len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[n], self.counts[n] = self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.known.add(key)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a slice, and where each text's ids begin (one more entry at the end)."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        chunk_start, chunk_end, _ = word_spans(data, offsets, NOT_SPACE)
        if not len(chunk_start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # Letters of one byte, or of two from U+00C0 to U+00FF without the signs for times and division.
        letter = _LETTER[data]
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[:-1] |= pair
        letter[1:] |= pair
        plain = letter | _PUNCTUATION[data]
        plain[:-1] &= ~((data[:-1] == 60) & (data[1:] == 124))  # what may be a special token
        hard = np.add.reduceat(np.concatenate([~plain, [False]]).astype(np.int32), np.stack([chunk_start, chunk_end], 1).ravel())[::2] > 0
        low = LOWER[data]
        capital = pair & (data[1:] <= 0x9E)
        low[1:][capital] += 32
        # Hard words stay whole, bytes as they are; in the others a part begins where letters begin or end.
        in_hard = np.zeros(len(data) + 1, np.int32)
        np.add.at(in_hard, chunk_start[hard], 1)
        np.add.at(in_hard, chunk_end[hard], -1)
        in_hard = np.cumsum(in_hard[:-1]) > 0
        low[in_hard] = data[in_hard]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = (letter[1:] != letter[:-1]) & ~in_hard[1:] & ~in_hard[:-1] & NOT_SPACE[data[1:]] & NOT_SPACE[data[:-1]]
        ends = begins.copy()
        begins[chunk_start] = True
        ends[chunk_end] = True
        starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
        part_hard = in_hard[starts]
        hashes = span_hashes(low, starts, ends) ^ part_hard.astype(np.uint64)
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = self.known.find(found)
        for i in np.flatnonzero(numbers < 0).tolist():
            at = first[i]
            numbers[i] = self._add(int(found[i]), low[starts[at] : ends[at]].tobytes(), bool(part_hard[at]))
        numbers = numbers[which]
        counts = self.counts[numbers]
        total = np.cumsum(counts)
        where = np.repeat(self.starts[numbers] - (total - counts), counts) + np.arange(total[-1])
        begin = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return self.ids[where], begin


def word_tokens(path: str) -> WordTokens:
    """The pieces this Python worker knows; they serve all its tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: largest first, each into the fullest bin that has room."""
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    some_free = 0  # a bit for each number of free places that some bin has
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some_free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            own = open_bins[free]
            b = own.pop()
            if not own:
                some_free ^= 1 << free
        else:
            free, b = capacity, n
            n += 1
        bins[i] = b
        offsets[i] = capacity - free
        left = free - size
        if left:
            open_bins[left].append(b)
            some_free |= 1 << left
    return bins, offsets


def _number(k: int) -> int:
    """First bin number of the task: 2^23 partitions times 2^40 bins."""
    return (TaskContext.get().partitionId() << 40) + k


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize documents, cut them into pieces and pack the pieces of each partition.

    Returns doc_id, piece, start, length, ids_crc32, bin, place (in the bin) and, on the first piece of a bin,
    filled (its total). A document is its ids and a 0; null and empty texts are the 0 alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, filled long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        rows: list[tuple] = []
        made = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not rows:
                return
            sizes = np.array([r[3] for r in rows], np.int64)
            bins, places = best_fit(sizes, capacity)
            totals = np.bincount(bins, sizes).astype(np.int64)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            filled = pa.array(totals[bins], mask=places > 0)
            columns += [pa.array(bins + _number(made)), pa.array(places), filled]
            made += len(totals)
            rows.clear()
            whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "filled"])
            for i in range(0, whole.num_rows, 10_000):
                yield whole.slice(i, 10_000)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, _, data, offsets in slices(batch.column("text"), SHORT_BYTES):
                all_ids, begin = tokens.encode(data, offsets)
                for i in range(len(offsets) - 1):
                    ids = all_ids[begin[i] : begin[i + 1]].astype("<u4").tobytes() + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_ids[first + i], k, at // 4, len(part) // 4, zlib.crc32(part)))
                if len(rows) >= ITEMS_AT_ONCE:
                    yield from packed()
        yield from packed()

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def _merged(bins: DataFrame, partitions: int, capacity: int) -> DataFrame:
    """Pack bins (bin, filled) as items. root is the first bin of the new one, base the place in it, total its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            own, size = np.concatenate(ids), np.concatenate(sizes)
            order = np.lexsort((own, -size))
            own, size = own[order], size[order]
            bins_, base = best_fit(size, capacity)
            first = np.zeros(bins_.max() + 1, np.int64)
            first[bins_[base == 0]] = own[base == 0]
            total = np.bincount(bins_, size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(first[bins_]), pa.array(base), pa.array(total[bins_])], ["bin", "root", "base", "total"])
            ids.clear()
            sizes.clear()

        for batch in batches:
            ids.append(batch.column("bin").to_numpy())
            sizes.append(batch.column("filled").to_numpy())
            if sum(map(len, ids)) >= ITEMS_AT_ONCE:
                yield from packed()
        yield from packed()

    return bins.repartition(partitions, "bin").sortWithinPartitions("bin").mapInArrow(run, "bin long, root long, base long, total long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    nearly_full: int = NEARLY_FULL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most capacity tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. Only documents longer than
    capacity are cut. Rows that repeat are packed each. An empty table gives no rows.
    """
    local = stable(pieces(docs, tokenizer_path, capacity, id_col, text_col))
    rest = local.where(F.col("filled") < capacity - nearly_full).select("bin", "filled")
    partitions = max(1, local.rdd.getNumPartitions())
    moved = None
    count = rest.count()
    while count > 1:
        partitions = max(-(-partitions // FAN_IN), -(-count // ITEMS_AT_ONCE))
        merged = stable(_merged(rest, partitions, capacity))
        if moved is None:
            moved = merged.select("bin", "root", "base")
        else:
            step = merged.select(F.col("bin").alias("root"), F.col("root").alias("next"), F.col("base").alias("more"))
            further = moved.join(step, "root", "left")
            moved = stable(further.select("bin", F.coalesce("next", "root").alias("root"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")))
        rest = merged.where((F.col("base") == 0) & (F.col("total") < capacity - nearly_full)).select(F.col("root").alias("bin"), F.col("total").alias("filled"))
        left = rest.count()
        if partitions == 1 or left > 0.995 * count and partitions == -(-count // ITEMS_AT_ONCE):
            break
        count = left
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return local.select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    final = local.join(moved, "bin", "left")
    return final.select(
        *columns, F.coalesce("root", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset")
    )
