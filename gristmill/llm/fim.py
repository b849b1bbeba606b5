"""Fill-in-the-middle: texts are cut at two unit boundaries, and the middle goes to the end behind sentinels.

Every byte of a text has one of eight classes: inside a character, inside a run of letters, opening a run, white space,
line break, digit, other ASCII, other. A wavelet matrix over them holds one bit a byte and level, the classes' high bits
first, each level in the order of the bits above it. Counting the bytes up to a place whose class is below a bound takes
one rank per level, so the boundaries up to any place are a difference of two ranks: units of a text are the classes
from OPENS[unit] on. A cut after c units is found by bisection on these ranks, for all texts of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import SLICE_BYTES, slices, texts

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut, and so many of these have the suffix first.
RATE = 90
SUFFIX_FIRST = 20

INSIDE, LETTER, OPENING, SPACE, BREAK, DIGIT, ASCII, OTHER = range(8)
#: The first class that opens a unit; all above it do, too. A token is a run of A-Z and a-z, or one other character.
OPENS = {"token": OPENING, "character": LETTER}
_LEVELS = (2, 1, 0)

_CLASS = np.full(256, ASCII, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = BREAK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = LETTER
_CLASS[97:123] = LETTER
_CLASS[128:192] = INSIDE
_CLASS[192:] = OTHER


def classes(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """Classes of the bytes first to last of a slice of texts."""
    found = _CLASS[data[first:last]]
    letter = found == LETTER
    opening = letter.copy()
    opening[1:] &= ~letter[:-1]
    if first and letter[:1].any() and _CLASS[data[first - 1]] == LETTER:
        opening[0] = False
    starts = offsets[:-1]
    starts = starts[(starts >= first) & (starts < last)] - first
    opening[starts] |= letter[starts]
    found[opening] = OPENING
    return found


class Bits:
    """A row of bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)[:-1]])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & low)


class WaveletMatrix:
    """Classes 0 to 7 as three rows of bits; 3 bits and a little more a place."""

    def __init__(self, values: np.ndarray):
        self._rows: list[tuple[int, Bits, int]] = []
        for level in _LEVELS:
            bits = (values >> level & 1).astype(bool)
            zeros = values[~bits]
            self._rows.append((level, Bits(bits), len(zeros)))
            values = np.concatenate([zeros, values[bits]])

    def below(self, place: np.ndarray, bound: int) -> np.ndarray:
        """How many of the first `place` values are smaller than the bound."""
        first, last = np.zeros_like(place), place
        found = np.zeros_like(place)
        for level, bits, zeros in self._rows:
            a, b = bits.ones(first), bits.ones(last)
            if bound >> level & 1:
                found = found + (last - b) - (first - a)  # those with a zero here are smaller
                first, last = zeros + a, zeros + b
            else:
                first, last = first - a, last - b
        return found


class Boundaries:
    """Counts of units over a slice of texts, in blocks, so that a long text needs little more than its own bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = 0):
        self._block = block or SLICE_BYTES
        self._matrices = []
        before = {bound: [0] for bound in {LETTER, OPENING}}
        for first in range(0, len(data), self._block):
            last = min(first + self._block, len(data))
            matrix = WaveletMatrix(classes(data, offsets, first, last))
            self._matrices.append(matrix)
            for bound, totals in before.items():
                totals.append(totals[-1] + int(matrix.below(np.array([last - first]), bound)[0]))
        self._before = {bound: np.array(totals) for bound, totals in before.items()}

    def opened(self, place: np.ndarray, bound: int) -> np.ndarray:
        """How many bytes before a place have a class of at least the bound."""
        block = np.minimum(place // self._block, max(len(self._matrices) - 1, 0))
        below = self._before[bound][block]
        for b in np.unique(block).tolist() if self._matrices else []:
            here = block == b
            below[here] += self._matrices[b].below(place[here] - b * self._block, bound)
        return place - below

    def cut(self, first: np.ndarray, last: np.ndarray, units: np.ndarray, bound: int) -> np.ndarray:
        """Where the texts at first to last end their first `units` units: the place at which the next one opens."""
        wanted = self.opened(first, bound) + units
        low, high = first.copy(), last.copy()  # the unit opens at low or later; at high if none does
        while (low < high).any():
            middle = (low + high) // 2
            # An empty search stays where it is: then middle + 1 may lie beyond the slice.
            enough = (low >= high) | (self.opened(np.minimum(middle + 1, last), bound) > wanted)
            high = np.where(enough & (low < high), middle, high)
            low = np.where(enough, low, middle + 1)
        return np.where(units == 0, first, low)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 from the hash of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(
    docs: DataFrame,
    seed: int = 1,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    unit: str = "token",
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, which leaves the text as it is: of the
    share beyond `rate`, of empty and null texts, and where a text holds a sentinel, so that restored() is exact. The
    cuts are drawn from a hash of seed and id: rows that repeat an id and a text are cut alike, a null id counts as empty
    text. Units are runs of ASCII letters and single other characters, or characters. Other columns of docs are not
    looked at. A long text takes about twice its bytes beside its own.
    """
    bound, marks = OPENS[unit], [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [np.asarray(batch.column(f"h{k}")) for k in range(1, 5)]
            for top, end, data, offsets in slices(batch.column("text")):
                units = Boundaries(data, offsets)
                first, last = offsets[:-1], offsets[1:]
                n = units.opened(last, bound) - units.opened(first, bound)
                h1, h2, h3, h4 = (h[top:end] for h in drawn)
                c1, c2 = h1 % (n + 1), h2 % (n + 1)
                a = units.cut(first, last, np.minimum(c1, c2), bound)
                b = units.cut(first, last, np.maximum(c1, c2), bound)
                chars = [units.opened(place, LETTER) for place in (first, a, b)]
                forms, outputs = [], []
                for x, p, q, y, plain, swapped in zip(first, a, b, last, h3 % 100 >= rate, h4 % 100 < suffix_first, strict=True):
                    raw = data[x:y].tobytes()
                    if plain or not raw or any(s in raw for s in marks):
                        forms.append("plain")
                        outputs.append(raw)
                        continue
                    prefix, middle, suffix = raw[: p - x], raw[p - x : q - x], raw[q - x :]
                    head = (marks[1], suffix, marks[0], prefix) if swapped else (marks[0], prefix, marks[1], suffix)
                    forms.append("spm" if swapped else "psm")
                    outputs.append(b"".join((*head, marks[2], middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                lengths = [pa.array(y - x, pa.int64(), mask=plain) for x, y in zip(chars, chars[1:], strict=False)]
                columns = [batch.column("doc_id").slice(top, end - top), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *lengths]
                out = pa.array(outputs, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    data = texts(docs, id_col, text_col, *draws(docs[id_col].cast("long"), seed))
    return data.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that transform() was given, from its form and output. No part of a cut text holds a sentinel."""
    before, after, last = (F.lit(s) for s in sentinels)

    def part(start: Column, stop: Column) -> Column:
        return output.substr(start, stop - start)

    psm = F.concat(
        part(F.length(before) + 1, F.instr(output, sentinels[1])),
        part(F.instr(output, sentinels[2]) + F.length(last), F.length(output) + 1),
        part(F.instr(output, sentinels[1]) + F.length(after), F.instr(output, sentinels[2])),
    )
    spm = F.concat(
        part(F.instr(output, sentinels[0]) + F.length(before), F.instr(output, sentinels[2])),
        part(F.instr(output, sentinels[2]) + F.length(last), F.length(output) + 1),
        part(F.length(after) + 1, F.instr(output, sentinels[0])),
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
