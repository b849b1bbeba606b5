"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected.

A line with a word fails if
* punctuation: it does not end with a sentence mark and has fewer than FRAGMENT characters in its words, or at least
  SHOUTED percent of its words, of five or more, end with an exclamation or question mark;
* navigation: at least three of its words, and SEPARATED percent of them, are separators;
* boilerplate: one of PHRASES is in it, SYMBOLIC percent of the characters of its words are symbols, or the same line
  stood earlier in the text.
Lines are weighed by the characters of their words. Thresholds compare whole numbers, so any engine gives the same answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import LOWER, NOT_SPACE, SLICE_BYTES, mix, shingle_hashes, slices, span_hashes, texts, word_spans

FRAGMENT = 40
SHOUTED = 30
SEPARATED = 20
SYMBOLIC = 10
#: A text is rejected if its failing lines hold more than this percentage of the characters of its words.
LOST = 50
#: Fewer words, or more than this percentage of them in repeated windows of three words, fail whatever the lines.
MIN_WORDS = 50
REPEATED = 50
WINDOW = 3

# Marks that end a sentence, words that part the entries of a menu, symbols, phrases of boilerplate.
SENTENCE_MARKS = ".!?:;\"')]}…。！？”’»।؟"
SEPARATORS = ("|", "||", ">", ">>", "»", "/", "-", "–", "—", "·", "•", "*", "::")
SYMBOLS = "#*$%&|<>"
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "use cookies",
)

_PHRASES = re.compile("|".join(PHRASES).encode())
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _tails(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The last character of each word of up to three bytes, as a number."""
    last = data[ends - 1].astype(np.int64)
    for back in (2, 3):
        inside = (last & 0xC0 << 8 * (back - 2)) == 0x80 << 8 * (back - 2)
        more = inside & (ends - back >= starts)
        last = np.where(more, last | data[np.maximum(ends - back, 0)].astype(np.int64) << 8 * (back - 1), last)
    return last


def _numbers(marks: str) -> np.ndarray:
    return np.array([int.from_bytes(m.encode(), "big") for m in marks], np.int64)


_MARKS, _SHOUTS = _numbers(SENTENCE_MARKS), _numbers("!?")
_SEPARATOR_HASHES = np.concatenate([span_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s.encode())])) for s in SEPARATORS])


class _Block:
    """Whole lines of a slice of texts, without regard to other lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.at = word_spans(data, offsets, NOT_SPACE)
        self.words = span_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 10)
        begin = np.union1d(offsets[:-1], breaks[breaks + 1 < len(data)] + 1)
        first = np.searchsorted(starts, begin)
        last = np.append(first, len(starts))[1:]
        begin, first, last = (x[last > first] for x in (begin, first, last))
        text = np.searchsorted(self.at, first, "right") - 1
        # Lines stop before their line break, or with their text.
        stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[text + 1])
        n_words = last - first
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int32)])
        sums = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
        chars = sums[last] - sums[first]
        self.symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        self.word_chars = sums[self.at[1:]] - sums[self.at[:-1]]

        tail = _tails(data, ends, starts)
        shouted = np.concatenate([[0], np.cumsum(np.isin(tail, _SHOUTS))])
        shouted = shouted[last] - shouted[first]
        parted = np.concatenate([[0], np.cumsum(np.isin(self.words, _SEPARATOR_HASHES))])
        parted = parted[last] - parted[first]
        punctuation = ~np.isin(tail[last - 1], _MARKS) & (chars < FRAGMENT) | (n_words >= 5) & (100 * shouted >= SHOUTED * n_words)
        navigation = (parted >= 3) & (100 * parted >= SEPARATED * n_words)
        boilerplate = 100 * (symbols[stop] - symbols[begin]) >= SYMBOLIC * chars
        places = np.array([m.span() for m in _PHRASES.finditer(LOWER[data].tobytes())], np.int64).reshape(-1, 2)
        line = np.searchsorted(begin, places[:, 0], "right") - 1
        found = line >= 0
        boilerplate[line[found][places[found, 1] <= stop[line[found]]]] = True
        content = mix(span_hashes(data, begin, stop) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.lines = [begin, stop, text, chars, punctuation, navigation, boilerplate, content]


def _line_blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last byte of the blocks of a long text, which end with a line."""
    first = 0
    while first < len(data):
        last = min(first + SLICE_BYTES, len(data))
        while last < len(data) and data[last - 1] != 10:
            breaks = np.flatnonzero(data[last : last + SLICE_BYTES] == 10)
            last = last + int(breaks[0]) + 1 if len(breaks) else min(last + SLICE_BYTES, len(data))
        yield first, last
        first = last


class Lines:
    """The lines with a word of a slice of texts, and which of them fail. A long text is read in blocks of whole lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
            blocks = [_Block(data, offsets)]
        else:
            blocks = []
            for a, b in _line_blocks(data):
                blocks.append(_Block(data[a:b], np.array([0, b - a])))
                blocks[-1].lines[0] += a
                blocks[-1].lines[1] += a
        self.words = np.concatenate([x.words for x in blocks])
        self.at = blocks[0].at if len(blocks) == 1 else np.array([0, len(self.words)])
        self.symbols, self.word_chars = sum(x.symbols for x in blocks), sum(x.word_chars for x in blocks)
        columns = [np.concatenate(c) for c in zip(*(x.lines for x in blocks), strict=True)]
        self.begin, self.stop, self.text, self.chars, self.punctuation, self.navigation, self.boilerplate, content = columns
        self.later = np.ones(len(content), bool)
        self.later[np.unique(content, return_index=True)[1]] = False
        self.boilerplate = self.boilerplate | self.later
        self.failed = self.punctuation | self.navigation | self.boilerplate

    def per_text(self, which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        n = len(self.at) - 1
        return np.bincount(self.text[which], None if weights is None else weights[which], n).astype(np.int64)

    def repeated_words(self) -> np.ndarray:
        """Per text the words in windows of WINDOW words that it holds more than once."""
        n = len(self.words)
        inside = np.zeros(n + 1, np.int64)
        if n >= WINDOW:
            text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
            first = np.flatnonzero(text[WINDOW - 1 :] == text[: n - WINDOW + 1])
            own = mix(shingle_hashes(self.words, WINDOW)[first] + text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, which, found = np.unique(own, return_inverse=True, return_counts=True)
            first = first[found[which] > 1]
            np.add.at(inside, first, 1)
            np.add.at(inside, first + WINDOW, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
        return covered[self.at[1:]] - covered[self.at[:-1]]


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")


def clean(docs: DataFrame, lost: int = LOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, measures of its text, base_failed, kept, and text, without the failing lines.

    Words are parted by ASCII white space, lines by line feeds; lines without a word stay. n_lines counts lines with a
    word, n_punctuation, n_navigation and n_boilerplate those that fail each rule (a line may fail several), lost_chars
    the characters of words in failing lines. A text fails at its base with too few words or too many in repeated
    windows; it is kept if it does not and its failing lines hold at most `lost` percent of its characters. Null texts
    count as empty, which fail at their base. Each row is answered, also those that repeat an id. Other columns of docs
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, end, data, offsets in slices(batch.column("text")):
                found = Lines(data, offsets)
                every = np.ones(len(found.begin), bool)
                gone = found.per_text(found.failed, found.chars)
                n_words, repeats = np.diff(found.at), found.repeated_words()
                measures = [n_words, found.word_chars, found.symbols, found.per_text(found.later), repeats, found.per_text(every)]
                measures += [found.per_text(rule) for rule in (found.punctuation, found.navigation, found.boilerplate)] + [gone]
                base = (n_words < MIN_WORDS) | (100 * repeats > REPEATED * n_words)
                kept = ~base & (100 * gone <= lost * found.word_chars)
                # A failing line goes with its line break.
                change = np.zeros(len(data) + 1, np.int8)
                limits = offsets[found.text + 1]
                np.add.at(change, found.begin[found.failed], 1)
                np.add.at(change, np.minimum(found.stop + 1, limits)[found.failed], -1)
                stay = np.cumsum(change[:-1], dtype=np.int8) == 0
                place = np.concatenate([[0], np.cumsum(stay)])[offsets]
                left = pa.Array.from_buffers(pa.large_string(), end - top, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[stay].tobytes())])
                arrays = [batch.column("doc_id").slice(top, end - top), *(pa.array(m, pa.int64()) for m in measures), pa.array(base), pa.array(kept), left.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COLUMNS, "base_failed", "kept", "text"])

    schema = "doc_id long, " + "".join(f"{c} long, " for c in _COLUMNS) + "base_failed boolean, kept boolean, text string"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
