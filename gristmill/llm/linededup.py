"""Passages of MIN_WORDS words and more that occur a second time, cut from all but their first place.

Found with a suffix array over the sequences of line ids. A line begins at a word whose hash, with that of the next word,
is below those of the REACH words on either side: lines are longer than REACH words, and a passage has the same lines
wherever it was pasted, inside longer lines as well. Line ids are 64-bit hashes of the lines' words.

The array is built by prefix doubling: the rank of 2^k lines and that of the next 2^k are sorted as pairs, which ranks
2^(k+1) lines. Pairs that occur once end no repeated run and are dropped. The suffixes that share their first u lines are
an LCP interval; its name is the two ranks of 2^k lines, 2^k <= u < 2^(k+1), that begin and end these u lines.

Windows of MIN_WORDS words that see the same lines and lie in the same longer run, their cover, stand or fall together.
A later place of a repeated cover is cut as a whole. Where an interval has as many places as its cover, the run goes on at
every place and nothing more is to be told there. What is left are the ends of maximal repeated runs: there, each window is
grown word by word from the interval's lines, by a hash of the words before its first and after its last line, and all but
the first place of a grown interval are cut. Longer passages are unions of these. Lines that occur once, as a bitmap of
fixed size tells, take no part, nor do windows that see one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.llm.common import KEY_BITS, NOT_SPACE, SHORT_BYTES, Scratch, bitmap, few_rows, in_order, marked, mix, slices, span_hashes, text_key, texts, tidy, word_spans, written

#: A passage of fewer words is left alone.
MIN_WORDS = 50
#: A line begins at a word that no other within so many words on either side may begin one; 2 * REACH + 1 words on average.
REACH = 5
FILTER_BITS = 27
#: The bitmap of lines is put together in pieces of 2^PIECE_BITS places, from lists of about HELD_PLACES places in all.
PIECE_BITS = 19
HELD_PLACES = 1 << 18
_LAST = (1 << 63) - 1

_FACTOR = np.uint64(0x9FB21C651E98DF25)
_UNFACTOR = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the first word of each text (one more entry).

    Words are parted by white space. Han, kana, Thai and Lao have none, so each of their characters is a word.
    """
    wide = (data >= 0xE3) & (data <= 0xE9)
    thai = data[:-1] == 0xE0
    wide[:-1] |= thai & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    if not wide.any():
        return word_spans(data, offsets, NOT_SPACE)
    n = len(data)
    inside = NOT_SPACE[data]
    cut = np.zeros(n + 4, bool)  # between a byte and the one before
    cut[0] = cut[n] = True
    cut[offsets] = True
    cut[:n] |= wide
    cut[3 : n + 3] |= wide
    starts, ends = inside & cut[:n], inside & cut[1 : n + 1]
    starts[1:] |= inside[1:] & ~inside[:-1]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    found = np.flatnonzero(starts)
    return found, np.flatnonzero(ends) + 1, np.searchsorted(found, offsets)


def _openings(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words at which a line begins: REACH words before and REACH + 1 after them, all of their text, decide on it."""
    n = len(hashes)
    opens = np.zeros(n, bool)
    if n < 2 * REACH + 2:
        return opens
    value = mix(hashes[:-1] + hashes[1:] * _FACTOR)
    inner = value[REACH : n - 1 - REACH]
    lowest = np.ones(len(inner), bool)
    for j in range(1, REACH + 1):
        lowest &= inner < value[REACH - j : n - 1 - REACH - j]
        lowest &= inner < value[REACH + j : n - 1 - REACH + j]
    opens[REACH : n - 1 - REACH] = lowest
    edge = np.zeros(n + 1, np.int32)  # words too near to an end of their text
    first, last = at[:-1], at[1:]
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + REACH, last), -1)
    np.add.at(edge, np.maximum(last - REACH - 1, first), 1)
    np.add.at(edge, last, -1)
    return opens & (np.cumsum(edge[:-1]) == 0)


class Lines:
    """The lines of a slice of texts, and the windows of min_words words with the whole lines that each sees.

    A window sees a line if the words that decide on its begin and end are in the window.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int) -> None:
        starts, ends, self.at = words(data, offsets)
        n = len(starts)
        hashes = span_hashes(data, starts, ends)
        factors = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _FACTOR)]), dtype=np.uint64)
        self._back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _UNFACTOR)]), dtype=np.uint64)
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * factors[:n], dtype=np.uint64)])
        opens = _openings(hashes, self.at)
        self.begin = np.flatnonzero(opens)
        self.first = np.searchsorted(self.begin, self.at)  # the first line of each text
        # The words from the last begin of a text on are no line.
        self.whole = np.ones(max(len(self.begin) - 1, 0), bool)
        ends_of = self.first[1:][np.diff(self.first) > 0] - 1
        self.whole[ends_of[ends_of < len(self.whole)]] = False
        self.ids = self._run(self.begin[:-1], self.begin[1:])
        # Windows: the first word, and the lines seen from low to high.
        size = np.diff(self.at)
        fits = np.zeros(n + 1, np.int32)
        text = np.flatnonzero(size >= min_words)
        np.add.at(fits, self.at[text], 1)
        np.add.at(fits, self.at[text + 1] - min_words + 1, -1)
        self.word = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        self._count = np.concatenate([[0], np.cumsum(opens)])
        self.low = self._count[np.minimum(self.word + REACH, n)]
        seen = self._count[np.maximum(self.word + min_words - 1 - REACH, 0)] - self.low
        self.lines = np.maximum(seen - 1, 0)
        self._min_words = min_words

    def _run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b."""
        return mix((self._sums[b] - self._sums[a]) * self._back[a] + (b - a).astype(np.uint64))

    def edges(self, window: np.ndarray) -> np.ndarray:
        """Hashes of the words of some windows before their first and after their last line; of all if they see none."""
        a = self.word[window]
        end = a + self._min_words
        if not len(self.begin):
            return self._run(a, end)
        low, lines = self.low[window], self.lines[window]
        left = np.where(lines == 0, end, self.begin[np.minimum(low, len(self.begin) - 1)])
        right = np.where(lines == 0, end, self.begin[np.minimum(low + lines, len(self.begin) - 1)])
        return mix(self._run(a, left) * _FACTOR + self._run(right, end))

    def places(self) -> np.ndarray:
        """Places in the bitmap: those of the whole lines, and of windows that see none."""
        return _place(np.concatenate([self.ids[self.whole], self.edges(np.flatnonzero(self.lines == 0))]))

    def groups(self, marks: np.ndarray) -> dict[str, np.ndarray]:
        """Windows that see no line that occurs only once, those of equal lines as one group.

        all: the windows; window: the first of each group, n: how many; low, lines: what they see; cover, covered: the
        lines around all of them, none if the text ends before or if one occurs only once.
        """
        single = np.concatenate([[0], np.cumsum(~marked(marks, _place(self.ids)))])
        low, some = self.low, self.lines > 0
        keep = np.zeros(len(self.word), bool)
        keep[some] = single[low[some]] == single[(low + self.lines)[some]]
        bare = np.flatnonzero(~some)
        keep[bare] = marked(marks, _place(self.edges(bare)))
        kept = np.flatnonzero(keep)
        low, lines = low[kept], self.lines[kept]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(low) != 0) | (np.diff(lines) != 0) | (lines[1:] == 0)
        top = np.flatnonzero(new)
        n = np.diff(np.append(top, len(kept)))
        low, lines, word = low[top], lines[top], self.word[kept[top]]
        start, stop = self._count[word + 1] - 1, self._count[word + n - 1 + self._min_words]  # the begins around the windows
        text = np.searchsorted(self.at, word, "right") - 1
        inside = (start >= self.first[text]) & (stop < self.first[text + 1]) & (lines > 0)
        inside[inside] = single[start[inside]] == single[stop[inside]]
        cover, covered = np.where(inside, start, 0), np.where(inside, stop - start, 0)
        return {"all": kept, "window": kept[top], "n": n, "text": text, "low": low, "lines": lines, "cover": cover, "covered": covered}


def _place(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - FILTER_BITS)).astype(np.int32)


def _top_levels(low: np.ndarray, lines: np.ndarray, n: int) -> np.ndarray:
    """For n lines the highest level at which a rank can matter to windows of so many lines, -1 if to none."""
    top = np.full(n, -1, np.int32)
    level = 0
    while True:
        long = lines >= 1 << level
        if not long.any():
            return top
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, low[long], 1)
        np.add.at(marks, (low + lines)[long] - (1 << level) + 1, -1)
        top[np.cumsum(marks[:-1]) > 0] = level
        level += 1


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: ids, subs, bytes and offsets."""
    for batch in few_rows(batches, 1024):
        ids, subs = np.asarray(batch.column("id")), np.asarray(batch.column("sub"))
        for top, end, data, offsets in slices(batch.column("text"), SHORT_BYTES):
            yield ids[top:end], subs[top:end], data, offsets


class Texts:
    """The texts to search: those of docs that a bitmap of copies does not hold, and the strays, which it holds by chance."""

    def __init__(self, docs: DataFrame, copied: DataFrame, strays: DataFrame) -> None:
        self.spark, self.context = docs.sparkSession, docs.sparkSession.sparkContext
        told = _with_bits(docs, copied)
        self._parts = [told.where("not copied")]
        if not strays.isEmpty():
            self._parts.append(told.where("copied").join(strays, ["id", "sub"], "left_semi"))

    def each(self, run: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """run on the slices of all texts."""
        found = [p.select("id", "sub", "text").mapInArrow(lambda batches: run(_searched(batches)), schema) for p in self._parts]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of binary values: the next counts[i] entries of values for row i."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    cuts = (np.concatenate([[0], np.cumsum(counts)]) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """What _packed made binary rows of, without nulls: the values and how many belong to each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, cuts, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros((0, width) if width > 1 else 0, kind), np.zeros(len(column), int)
    cuts = np.frombuffer(cuts, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].view(kind)
    return values.reshape(-1, width) if width > 1 else values, np.diff(cuts) // (np.dtype(kind).itemsize * width)


def _repeated_places(searched: Texts, min_words: int) -> np.ndarray:
    """A bitmap of fixed size that holds all lines that occur twice, and others by chance.

    Places travel as sorted lists for each piece of the bitmap, the sign bit marks those that a list found twice.
    """
    most = (1 << PIECE_BITS) - 1

    def lists(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places, n = np.unique(np.concatenate(held), return_counts=True)
        parts = places >> PIECE_BITS
        found, counts = np.unique(parts, return_counts=True)
        marked_ = (places & most) | np.where(n > 1, -1 << 31, 0)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), _packed(marked_.astype(np.int32), counts)], ["part", "places"])

    def run(slices_: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, _, data, offsets in slices_:
            held.append(Lines(data, offsets, min_words).places())
            size += len(held[-1])
            if size >= HELD_PLACES:
                yield from lists(held)
                held, size = [], 0
        if size:
            yield from lists(held)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        once, twice = np.zeros(most + 1, bool), np.zeros(most + 1, bool)

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "marks": [np.packbits(twice).tobytes()]})

        for batch in batches:
            parts = batch.column("part").to_numpy()
            values, counts = _unpacked(batch.column("places"), np.int32)
            edge = np.concatenate([[0], np.cumsum(counts)])
            for k in range(len(parts)):
                if parts[k] != part:
                    if part is not None:
                        yield piece()
                    part = int(parts[k])
                    once[:] = twice[:] = False
                mine = values[edge[k] : edge[k + 1]]
                at = mine & most
                twice[at] |= once[at] | (mine < 0)
                once[at] = True
        if part is not None:
            yield piece()

    marks = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    size = 1 << PIECE_BITS - 3
    for r in in_order(searched.each(run, "part int, places binary"), "part").mapInArrow(pieces, "part int, marks binary").collect():
        marks[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["marks"], np.uint8)
    return marks


#: Columns of a group of windows in candidates().
_GROUP = ("pos", "low", "lines", "cover", "covered", "n")


def candidates(searched: Texts, marks: Broadcast, min_words: int) -> DataFrame:
    """A row for each text that has groups of windows that may occur twice, with the lines in and around them.

    groups: for each group its first word, the lines it sees, the lines around, how many windows. edges: the hash of each
    window's edges. lines: place and the last level that needs it, for each line; line_ids its id. most is the last level of all.
    """
    names = ["id", "sub", "most", "groups", "edges", "lines", "line_ids"]

    def run(slices_: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for ids, subs, data, offsets in slices_:
            found = Lines(data, offsets, min_words)
            g = found.groups(marks.value)
            window, of = g["window"], g["text"]
            if not len(window):
                continue
            first = found.first[of]
            low, lines = np.concatenate([g["low"], g["cover"]]), np.concatenate([g["lines"], g["covered"]])
            some = lines > 0
            top = _top_levels(low[some], lines[some], len(found.begin))
            line = np.flatnonzero(top >= 0)
            of_line = np.searchsorted(found.first, line, "right") - 1
            cover = np.where(g["covered"] > 0, g["cover"] - first, 0)
            groups = np.stack([found.word[window] - found.at[of], g["low"] - first, g["lines"], cover, g["covered"], g["n"]], axis=1)
            places = np.stack([line - found.first[of_line], top[line]], axis=1)
            most = np.full(len(ids), -1, np.int32)
            np.maximum.at(most, of_line, top[line])
            text, n_groups = np.unique(of, return_counts=True)
            n_lines = np.bincount(of_line, minlength=len(ids))[text]
            n_edges = np.bincount(of, g["n"], len(ids)).astype(np.int64)[text]
            arrays = [
                pa.array(ids[text]),
                pa.array(subs[text]),
                pa.array(most[text]),
                _packed(groups.astype(np.int32), n_groups),
                _packed(found.edges(g["all"]), n_edges),
                _packed(places.astype(np.int32), n_lines),
                _packed(found.ids[line], n_lines),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return searched.each(run, "id long, sub long, most int, groups binary, edges binary, lines binary, line_ids binary")


def by_text(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of each text next to each other, in an order."""
    return rows.repartition("id", "sub").sortWithinPartitions("id", "sub", *order)


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray], pa.Table]]:
    """Sorted rows cut only between texts: the number of each row's text in the cut, the columns of numbers, the rows."""

    def cut_(rows: pa.Table, new: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Table]:
        columns = {n: rows.column(n).to_numpy() for n in rows.column_names if pa.types.is_integer(rows.schema.field(n).type)}
        return np.cumsum(np.concatenate([[0], new])).astype(np.int64), columns, rows

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, subs = (np.asarray(batch.column(n)) for n in ("id", "sub"))
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(subs) != 0)) + 1
        if held and last != (ids[0], subs[0]):
            cuts = np.concatenate([[0], cuts])
        last = (ids[-1], subs[-1])
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                i, s_ = rows.column("id").to_numpy(), rows.column("sub").to_numpy()
                yield cut_(rows, (np.diff(i) != 0) | (np.diff(s_) != 0))
            held = []
            batch = batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        rows = pa.Table.from_batches(held)
        i, s_ = rows.column("id").to_numpy(), rows.column("sub").to_numpy()
        yield cut_(rows, (np.diff(i) != 0) | (np.diff(s_) != 0))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where wanted keys are in sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


_PAIRS = "id long, sub long, pos int, r long, r2 long, top int"


def _pairs_of_lines(rows: DataFrame) -> DataFrame:
    """Pairs of a line's id and that of the next, from the rows of candidates()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, n = _unpacked(batch.column("lines"), np.int32, 2)
            ids, _ = _unpacked(batch.column("line_ids"), np.int64)
            text = np.repeat(np.arange(len(n)), n)
            pos, top = lines[:, 0], lines[:, 1]
            ok = np.flatnonzero((np.diff(text) == 0) & (np.diff(pos) == 1) & (top[:-1] > 0))
            own = pa.array(text[ok])
            arrays = [batch.column("id").take(own), batch.column("sub").take(own), *[pa.array(a) for a in (pos[ok], ids[ok], ids[ok + 1], top[ok])]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "sub", "pos", "r", "r2", "top"])

    return rows.where("most > 0").select("id", "sub", "lines", "line_ids").mapInArrow(run, _PAIRS)


def _ranked(pairs: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs that occur more than once, each with the rank of the two (id, sub, pos, r, top)."""
    pairs = write(pairs)
    several = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "r2")
    # Numbers that follow the order of the pairs: the partitions are ranges, numbered in order.
    ranked = write(several.repartitionByRange("r", "r2").sortWithinPartitions("r", "r2").withColumn("rank", F.monotonically_increasing_id()))
    return pairs.join(ranked, ["r", "r2"]).select("id", "sub", "pos", F.col("rank").alias("r"), "top")


def doubled(rows: DataFrame, level: int, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """From ranks of 2^level lines (id, sub, pos, r, top) those of twice as many, of pairs that occur more than once."""
    step = 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, f, _ in whole_texts(batches):
            keys = owner << 32 | f["pos"]
            other = _find(keys, keys + step)
            ok = np.flatnonzero((other >= 0) & (f["top"] > level))
            arrays = [f["id"][ok], f["sub"][ok], f["pos"][ok], f["r"][ok], f["r"][other[ok]], f["top"][ok]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["id", "sub", "pos", "r", "r2", "top"])

    return _ranked(by_text(rows.where(F.col("top") >= level), "pos").mapInArrow(run, _PAIRS), write)


def numbered(keys: DataFrame, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """The texts id, sub with their numbers t, from 0 and without gaps, in the order of id and sub."""
    spark = keys.sparkSession
    # The partitions are ranges, numbered in order; the upper bits of the new column are that number.
    places = write(keys.select("id", "sub").repartitionByRange("id", "sub").sortWithinPartitions("id", "sub").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    bases, total = [], 0
    for r in sorted(places.groupBy(part.alias("part")).count().collect()):  # one row for each partition
        bases.append((r["part"], total))
        total += r["count"]
    if total >= 1 << 31:
        raise ValueError("more than 2^31 texts")
    base = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    return places.withColumn("part", part).join(base, "part").select("id", "sub", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("t"))


def intervals(rows: DataFrame, ranks: DataFrame, numbers: DataFrame) -> DataFrame:
    """For the rows of candidates(), ranks of all levels from 1 on and the numbers of the texts: the groups of windows.

    Each has a, the name of the LCP interval of the lines it sees, and c, that of its cover and its place in it, 0 if there
    is no such interval. place and cover_place are its first word and its cover's first line after the number of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, f, rows_ in whole_texts(batches):
            texts_ = np.flatnonzero(f["level"] == -1)
            if not len(texts_):
                continue
            number = np.zeros(owner[-1] + 1, np.int64)
            number[owner[f["level"] == -2]] = f["r"][f["level"] == -2]
            taken = rows_.select(["groups", "edges", "lines", "line_ids"]).take(pa.array(texts_))
            groups, n_groups = _unpacked(taken.column("groups"), np.int32, len(_GROUP))
            g = {name: groups[:, k].astype(np.int64) for k, name in enumerate(_GROUP)}
            lines, n_lines = _unpacked(taken.column("lines"), np.int32, 2)
            edges, _ = _unpacked(taken.column("edges"), np.uint64)
            own = np.repeat(owner[texts_], n_groups)
            names = {0: (np.repeat(owner[texts_], n_lines) << 32 | lines[:, 0], _unpacked(taken.column("line_ids"), np.int64)[0])}
            for k in np.unique(f["level"][f["level"] > 0]).tolist():
                at = np.flatnonzero(f["level"] == k)  # in the order of texts and places
                names[k] = (owner[at] << 32 | f["pos"][at], f["r"][at])

            def name(low: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                line = own << 32 | low
                level = np.floor(np.log2(np.maximum(u, 1) + 0.5)).astype(int)
                h, found = np.zeros(len(own), np.uint64), np.zeros(len(own), bool)
                for k in np.unique(level[u > 0]).tolist():
                    if k not in names:
                        continue
                    keys, r = names[k]
                    pick = np.flatnonzero((level == k) & (u > 0))
                    x, y = _find(keys, line[pick]), _find(keys, line[pick] + u[pick] - (1 << k))
                    both = (x >= 0) & (y >= 0)
                    mine = pick[both]
                    h[mine] = mix(mix(r[x[both]].view(np.uint64) * _FACTOR + u[mine].astype(np.uint64)) + r[y[both]].view(np.uint64))
                    found[mine] = True
                return h, found

            u = g["lines"]
            a, found = name(g["low"], u)
            c, around = name(g["cover"], g["covered"])
            before = (g["low"] - g["cover"]).astype(np.uint64)
            c = np.where(around, mix(c + mix(before * _FACTOR + u.astype(np.uint64))), np.uint64(0))
            cuts = np.concatenate([[0], np.cumsum(g["n"])])
            bare = u == 0  # one window each, which its edges name
            a[bare] = mix(edges[cuts[:-1][bare]] + _FACTOR)
            text = number[own] << 32
            every = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(edges.view(np.int64)))
            arrays = [pa.array(x) for x in (text + g["pos"], text + g["cover"], a.view(np.int64), c.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*arrays, every], ["place", "cover_place", "a", "c", "edges"]).filter(pa.array(found | bare))

    every = rows.select("id", "sub", F.lit(-1).alias("level"), "groups", "edges", "lines", "line_ids")
    every = every.unionByName(numbers.select("id", "sub", F.lit(-2).alias("level"), F.col("t").alias("r")), allowMissingColumns=True)
    every = every.unionByName(ranks, allowMissingColumns=True).withColumns({n: F.coalesce(n, F.lit(0)) for n in ("pos", "r")})
    return by_text(every, "level", "pos").mapInArrow(run, "place long, cover_place long, a long, c long, edges array<long>")


def later_copies(searched: Texts, keys: DataFrame, repeats: bool, min_words: int = MIN_WORDS) -> DataFrame:
    """id, sub, runs (array of first words and numbers of windows) to cut.

    keys has id and sub of all texts. repeats: rows repeat an id and a text.
    """
    marks = searched.context.broadcast(_repeated_places(searched, min_words))  # of fixed size
    lines, found = Scratch(searched.spark), Scratch(searched.spark)
    rows = lines.write(candidates(searched, marks, min_words))
    if repeats:
        rows = lines.write(rows.dropDuplicates(["id", "sub"]))
    top = rows.agg(F.max("most")).first()[0] or 0
    ranks = searched.spark.createDataFrame([], "id long, sub long, level int, pos int, r long")
    level = None
    for k in range(top):
        level = lines.write(_ranked(_pairs_of_lines(rows), lines.write) if level is None else doubled(level, k, lines.write))
        ranks = ranks.unionByName(level.select("id", "sub", F.lit(k + 1).alias("level"), "pos", "r"))
    numbers = found.write(numbered(keys, lines.write))
    groups = found.write(intervals(rows, ranks, numbers))
    lines.delete()
    # Each place of an interval is one group.
    covers = found.write(groups.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min("cover_place").alias("first")))
    total = covers.groupBy("a").agg(F.sum("n").alias("places")).where("places > 1")
    # Written first, so that the join shuffles both sides itself and Spark can split an interval of many places.
    fates = found.write(covers.join(total, "a").select("a", "c", "n", "places", "first"))
    later = (F.col("c") != 0) & (F.col("cover_place") != F.col("first"))
    settled = (F.col("c") != 0) & (F.col("n") == F.col("places"))
    told = groups.join(fates, ["a", "c"]).withColumn("later", later).where(F.col("later") | ~settled)
    told = found.write(told.select("place", "later", F.size("edges").alias("n"), "a", F.when(~F.col("later"), F.col("edges")).alias("edges")))
    tidy(searched.spark)
    ends = told.where("not later").select("place", "a", F.posexplode("edges").alias("i", "edge"))
    ends = ends.select(F.xxhash64("a", "edge").alias("h"), (F.col("place") + F.col("i")).alias("place"))
    first = found.write(ends.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").drop("n"))
    single = ends.join(first, "h").where("place != first").select("place", F.lit(1).alias("n"))
    gone = told.where("later").select("place", "n").unionByName(single)
    run = F.struct(F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"), "n")
    runs = gone.groupBy(F.shiftright("place", 32).alias("t")).agg(F.collect_list(run).alias("runs"))
    runs = written(runs.join(numbers, "t").select("id", "sub", "runs"))
    found.delete()
    return runs


def cut(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, pos: np.ndarray, n: np.ndarray, whole: np.ndarray, min_words: int) -> tuple[pa.Array, np.ndarray]:
    """The texts of a slice without windows of min_words words, and how many words of each go.

    n windows begin at word pos and the next words of the texts numbered in text; texts marked in whole lose all their words if they have min_words.
    """
    begin, _, at = words(data, offsets)
    size = np.diff(at)
    gone = np.flatnonzero(whole & (size >= min_words))
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, at[text] + pos, 1)
    np.add.at(change, at[text] + pos + n - 1 + min_words, -1)
    np.add.at(change, at[gone], 1)
    np.add.at(change, at[gone + 1], -1)
    drop = np.cumsum(change[:-1]) > 0
    stop = np.append(begin, len(data))[1:]
    full = np.flatnonzero(size > 0)
    stop[at[full + 1] - 1] = offsets[full + 1]
    bytes_ = np.zeros(len(data) + 1, np.int32)
    np.add.at(bytes_, begin[drop], 1)
    np.add.at(bytes_, stop[drop], -1)
    np.add.at(bytes_, offsets[gone], 1)  # with the blanks before the first word
    np.add.at(bytes_, offsets[gone + 1], -1)
    stay = np.cumsum(bytes_[:-1]) == 0
    place = np.concatenate([[0], np.cumsum(stay)])[offsets]
    left = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[stay].tobytes())])
    n_cut = np.concatenate([[0], np.cumsum(drop)])[at]
    return left, np.diff(n_cut).astype(np.int32)


def _without(batch: pa.RecordBatch, field: int, whole: np.ndarray, runs: pa.Array | None, min_words: int) -> pa.RecordBatch:
    """Rows (column row) without their runs and, where whole says so, without all their words; and n_cut."""
    row = batch.column("row")
    text = row.field(field)
    sizes = np.zeros(len(text), int) if runs is None else np.asarray(pa.compute.list_value_length(runs).fill_null(0))
    touched = np.flatnonzero(whole | (sizes > 0))
    n_cut = np.zeros(len(text), np.int32)
    if len(touched):
        pos, n = (np.zeros(0, int) if runs is None else np.asarray(runs.flatten().field(k)) for k in (0, 1))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        new = []
        for top, end, data, offsets in slices(text.take(pa.array(touched)), SHORT_BYTES):
            mine = touched[top:end]
            of = np.repeat(np.arange(len(mine)), sizes[mine])
            some = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in mine.tolist()]) if len(of) else np.zeros(0, int)
            left, n_cut[mine] = cut(data, offsets, of, pos[some], n[some], whole[mine], min_words)
            new.append(left)
        mask = np.zeros(len(text), bool)
        mask[touched] = True
        changed = pa.concat_arrays(new).cast(text.type)
        texts_ = pa.compute.replace_with_mask(text, pa.array(mask & ~np.asarray(text.is_null())), changed.filter(pa.array(~np.asarray(text.is_null())[touched])))
        row = pa.StructArray.from_arrays([texts_ if i == field else row.field(i) for i in range(row.type.num_fields)], fields=list(row.type))
    return pa.RecordBatch.from_arrays([row, pa.array(n_cut)], ["row", "n_cut"])


def _bits(own: Column) -> Column:
    return F.shiftrightunsigned(own, 64 - KEY_BITS)


def _bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the texts id, sub."""
    return bitmap(keys.select(_bits(F.xxhash64("id", "sub")).alias("pos")), KEY_BITS)


def _pieces(spark: SparkSession, **marks: np.ndarray) -> DataFrame:
    """Bitmaps of 2^KEY_BITS places as a table of fixed size, 2^16 places of each as whole numbers of 64 bits in a row."""
    words_ = {n: np.packbits(np.unpackbits(m), bitorder="little").view(np.int64) for n, m in marks.items()}
    n = 1 << KEY_BITS - 16
    cuts = pa.array(np.arange(n + 1, dtype=np.int32) << 10)
    lists = [pa.ListArray.from_arrays(cuts, pa.array(w)) for w in words_.values()]
    return spark.createDataFrame(pa.table([pa.array(np.arange(n, dtype=np.int64)), *lists], ["_part", *words_]))


def _with_bits(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows, which have the hash own of their id and sub, with what each of the bitmaps says, without own."""
    names = [n for n in pieces.columns if n != "_part"]
    at = _bits(rows["own"])
    word, bit = F.shiftright(at, 6).bitwiseAND(1023).cast("int"), at.bitwiseAND(63).cast("int")
    found = rows.join(F.broadcast(pieces), F.shiftright(at, 16) == pieces["_part"])
    return found.select(*[rows[c] for c in rows.columns if c != "own"], *[(F.getbit(pieces[n][word], bit) == 1).alias(n) for n in names])


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, the text without later copies of passages of at least min_words words; and n_cut.

    n_cut counts the words that were cut. Texts are in the order of their ids, nulls last, then of a hash of the text. A
    text whose id is not the smallest with that text is a copy as a whole and becomes empty if it has min_words words.
    Rows that repeat an id and a text are one text, each gets the same result. Null texts stay null, empty tables give
    empty ones, and no other column is looked at. Columns of docs named n_cut are replaced.
    """
    spark = docs.sparkSession
    key = text_key(docs[text_col].cast("string"))
    data = texts(docs, id_col, text_col, key.alias("key"))
    ordered = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    keys = written(data.groupBy(ordered.alias("id"), "key").agg(F.count(F.lit(1)).alias("rows")).withColumn("sub", F.xxhash64("key")))
    repeats = (keys.agg(F.max("rows")).first()[0] or 0) > 1
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").drop("n")
    # Whole copies are told by their text alone: only the first of each text is searched.
    copies = written(keys.join(several, "key").where("id != first").select("id", "sub"))
    own = F.xxhash64("id", "sub").alias("own")
    copied = _bitmap_of(copies)
    held = _pieces(spark, copied=copied)
    strays = written(_with_bits(keys.select("id", "sub", own), held).where("copied").join(copies, ["id", "sub"], "left_anti").select("id", "sub"))
    searched = data.where("text is not null").select(ordered.alias("id"), F.xxhash64("key").alias("sub"), "text").select("*", own)
    runs = later_copies(Texts(searched, held, strays), keys, repeats, min_words)

    # A row in the bitmap of copies that is neither a stray nor has runs is a copy: its row stays where it is.
    doubt = _bitmap_of(runs.select("id", "sub").unionByName(strays))
    docs = docs.drop("n_cut")
    field = docs.columns.index(text_col)
    id_, sub = F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)), F.xxhash64(key)
    whole_rows = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    row = StructField("row", docs.select(whole_rows).schema["row"].dataType)
    result = StructType([row, StructField("n_cut", IntegerType())])

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            yield _without(batch, field, np.ones(batch.num_rows, bool), None, min_words)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            yield _without(batch, field, np.asarray(batch.column("copy").fill_null(False)), batch.column("runs"), min_words)

    rows = docs.select(whole_rows, id_.alias("id"), sub.alias("sub")).select("*", own)
    rows = _with_bits(rows, _pieces(spark, copied=copied, doubt=doubt))
    same = rows.where("not doubt and not copied").select("row.*", F.lit(0).alias("n_cut"))
    empty = rows.where("not doubt and copied").select("row").mapInArrow(emptied, result).select("row.*", "n_cut")
    changed = runs.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "sub", F.lit(None).cast("array<struct<pos:int,n:int>>").alias("runs"), F.lit(True).alias("copy")))
    # Whole rows pass by what changes in them, unsorted.
    joined = rows.where("doubt").select("row", "id", "sub").join(changed.hint("shuffle_hash"), ["id", "sub"], "left").select("row", "runs", "copy")
    return same.union(empty).union(joined.mapInArrow(done, result).select("row.*", "n_cut"))
