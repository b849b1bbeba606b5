"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least max(MIN_WORDS, MIN_PERIODS * q) words that no word beside
it extends. Each of its words occurs in it once a period, so MIN_PERIODS times or more. A word that occurs less often in
a segment thus joins none of its runs and splits it; the parts are looked at again with their own counts, until no
segment has such a word. Most segments of ordinary text vanish. Those left are scanned for lags: of the lags from s =
2^k to 2s - 1, one fits a grid point if the 2s words there recur after it, and a run with such a period holds a grid
point, s words apart, at which its period is the only lag that fits. Each lag that fits anywhere is held against the
whole segment, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import NOT_SPACE, SLICE_BYTES, mix, slices, span_hashes, texts, word_spans

MIN_WORDS = 6
MIN_PERIODS = 4
_FACTOR = np.uint64(0xA0761D6478BD642F)


def blocks(data: np.ndarray, most: int = 0) -> Iterator[tuple[int, int]]:
    """First and last byte of the blocks of a long text, which end at white space."""
    most = most or SLICE_BYTES
    first = 0
    while first < len(data):
        last = min(first + most, len(data))
        while last < len(data):  # on to the next white space
            space = np.flatnonzero(~NOT_SPACE[data[last : last + most]])
            if len(space):
                last += int(space[0])
                break
            last = min(last + most, len(data))
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice and the first word of each text (one more entry). A long text is read in blocks."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        starts, ends, at = word_spans(data, offsets, NOT_SPACE)
        return span_hashes(data, starts, ends), at
    found = []
    for a, b in blocks(data):
        starts, ends, _ = word_spans(data[a:b], np.array([0, b - a]), NOT_SPACE)
        found.append(span_hashes(data[a:b], starts, ends))
    every = np.concatenate(found)
    return every, np.array([0, len(every)])


def segments(words: np.ndarray, at: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int]]:
    """Stretches in which every word occurs min_periods times or more, of min_words words or more."""
    _, word = np.unique(words, return_inverse=True)
    pos = np.arange(len(words))
    segment = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found: list[tuple[int, int]] = []
    while len(pos):
        # Numbers of segments are below those of words, and so are numbers of words.
        _, which, n = np.unique(segment * np.int64(len(words) + 1) + word[pos], return_inverse=True, return_counts=True)
        common = n[which] >= min_periods
        opens = np.concatenate([[True], segment[1:] != segment[:-1]])
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~common]] = True
        settled = ~split[segment]
        first = np.flatnonzero(opens & settled)
        stops = np.append(np.flatnonzero(opens), len(pos))
        last = stops[np.searchsorted(stops, first, "right")]
        enough = last - first >= min_words
        found += zip(pos[first[enough]].tolist(), (pos[last[enough] - 1] + 1).tolist(), strict=True)
        stay = common & ~settled
        pos, segment = pos[stay], segment[stay]
        if len(pos):
            opens = np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(segment) != 0)])
            segment = np.cumsum(opens) - 1
            long = np.bincount(segment)[segment] >= min_words
            pos, segment = pos[long], segment[long]
            if len(pos):
                segment = np.cumsum(np.concatenate([[True], np.diff(segment) != 0])) - 1
    return sorted(found)


def lags(words: np.ndarray, min_periods: int) -> list[int]:
    """Lags that may be the period of a run of the segment."""
    n = len(words)
    hashes = mix(words + np.uint64(1))
    found: set[int] = set()
    step = 1
    while min_periods * step <= n:
        hashes = mix(hashes[: len(hashes) - step] * _FACTOR + hashes[step:])  # of 2 * step words
        rows = -(-(len(hashes) - step) // step)
        if rows <= 0:
            break
        later = np.zeros(rows * step, np.uint64)
        later[: len(hashes) - step] = hashes[step:]
        fits = later.reshape(rows, step) == hashes[: rows * step : step][:, None]
        fits.ravel()[len(hashes) - step :] = False
        several = fits.any(axis=1)
        found.update((step + np.unique(fits[several].argmax(axis=1))).tolist())
        step *= 2
    return sorted(found)


def scan(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Runs of a segment as (start, length, period)."""
    found: dict[tuple[int, int], int] = {}
    for q in lags(words, min_periods):
        least = max(min_words, min_periods * q) - q
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = words[q:] == words[:-q]
        change = np.diff(same)
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = last - first >= least
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            # Lags ascend: the same stretch with a smaller lag has that as its smallest period.
            found.setdefault((a, b + q), q)
    return [(a, b - a, q) for (a, b), q in found.items()]


def runs_of(words: np.ndarray, at: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text of a slice its runs as (start, length, period), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    for first, last in segments(words, at, min_words, min_periods):
        text = int(np.searchsorted(at, first, "right")) - 1
        base = first - int(at[text])
        found[text] += [(base + a, n, q) for a, n, q in scan(words[first:last], min_words, min_periods)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(data: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text joined by single spaces, without those of a run beyond its first period."""
    size = max((a + n for a, n, _ in runs), default=0)
    change = np.zeros(size + 1, np.int32)
    for a, n, q in runs:
        change[a + q] += 1
        change[a + n] -= 1
    keep = np.cumsum(change[:-1]) == 0
    parts, done = [], 0
    for a, b in blocks(data):
        words = data[a:b].tobytes().split()
        own = keep[done : done + len(words)].tolist()
        done += len(words)
        kept = [*compress(words, own), *words[len(own) :]]
        if kept:
            parts.append(b" ".join(kept))
    return b" ".join(parts)


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start, then period) and text, collapsed.

    Words are parted by ASCII white space and told apart by 64-bit hashes. The text returned has single spaces between
    words and lacks those that any run holds after its first period. Null, empty and blank texts have no words and no
    runs; their text is empty. Each row is answered, also those that repeat an id. Other columns of docs are not looked
    at. min_periods is at least 4. Memory is about ten times the bytes of the longest text; time is that of sorting, but for texts whose words
    hardly repeat less often than min_periods times.
    """
    if min_periods < 4:
        raise ValueError("the lag scan needs runs of four periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, end, data, offsets in slices(batch.column("text")):
                words, at = words_of(data, offsets)
                runs = runs_of(words, at, min_words, min_periods)
                left = [collapsed(data[a:b], r) for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), runs, strict=True)]
                listed = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], kind)
                arrays = [batch.column("doc_id").slice(top, end - top), pa.array(np.diff(at), pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "text"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
