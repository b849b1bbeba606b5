"""Language of a text: the nearest of several TF-IDF centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import slices, texts

#: Byte n-grams of these lengths are hashed into so many dimensions.
LENGTHS = (1, 2, 3)
DIMENSIONS = 1 << 13
#: Languages and centroids per language: the model's size does not depend on the data.
CENTROIDS = 4
#: The model is fitted on a sample of so many rows per language and so many bytes in all, at most.
SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 16_000_000
#: A text further from its centroid than all but this share of its language's sample is rejected.
REJECTED_SHARE = 0.001

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram of letters occurs in a text; runs of other characters are one blank."""
    letters = _LETTERS[data]  # UTF-8 of U+00C0 to U+00DE is C3, then 80 to 9E; small letters are 32 further on
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        letters[1:][capital] += 32
    blank = letters == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    letters = np.concatenate([[32], letters[keep], [32]]).astype(np.uint64)
    counts = np.zeros(DIMENSIONS, np.float32)
    gram = np.zeros(len(letters), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(letters) < n:
            break
        gram = gram[: len(letters) - n + 1] * np.uint64(256) + letters[n - 1 :]
        if n in LENGTHS:
            place = (gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)
            counts += np.bincount(place.view(np.int64), minlength=DIMENSIONS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one: 1 + log of the counts times the inverse document frequencies."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


class Model(NamedTuple):
    """Centroids of all languages, the language of each, and the cosine below which it rejects a text."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray


def _clusters(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from rows far from one another."""
    k = min(k, len(v))
    centres = [v[rng.integers(len(v))]]
    for _ in range(k - 1):
        far = 1 - np.max(v @ np.array(centres).T, axis=1)
        centres.append(v[int(np.argmax(far * rng.random(len(v))))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                c[j] = v[own == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS, seed: int = 7) -> Model:
    """A model from (text, language) pairs. Texts without letters and pairs with nulls are left out."""
    samples = [(t, lang) for t, lang in samples if t and lang and any(map(str.isalpha, t))]
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    rows = []  # only the n-grams that occur: the driver never holds the table of all texts
    found_in = np.zeros(DIMENSIONS, np.int64)
    for t, _ in samples:
        counts = gram_counts(np.frombuffer(t.encode(), np.uint8))
        some = np.flatnonzero(counts)
        found_in[some] += 1
        rows.append((some.astype(np.uint16), counts[some].astype(np.float32)))
    idf = np.log((1 + len(rows)) / (1 + found_in)).astype(np.float32) + 1
    rng = np.random.default_rng(seed)
    found, least = [], []
    for lang in languages:
        own = [r for r, (_, of) in zip(rows, samples, strict=True) if of == lang]
        v = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, (some, counts) in enumerate(own):
            v[i, some] = counts
            v[i] = weighted(v[i], idf)
        found.append(_clusters(v, centroids, rng))
        best = (v @ found[-1].astype(np.float32).T).max(axis=1)
        least.append(np.quantile(best.astype(float), REJECTED_SHARE))
        del v
    c = np.concatenate(found).astype(np.float32)
    language_of = np.repeat(np.arange(len(languages)), [len(x) for x in found])
    return Model(languages, idf, c, language_of, np.array(least))


def predict(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of counts: language number, how far it leads the other languages (0 to 1), whether it is rejected."""
    near = weighted(counts, model.idf) @ model.centroids.T
    by_language = np.stack([near[:, model.language_of == j].max(axis=1) for j in range(len(model.languages))], axis=1)
    own = np.argmax(by_language, axis=1)
    top = by_language[np.arange(len(own)), own]
    sharp = np.exp(25 * (by_language - top[:, None]))
    return own, 1 / sharp.sum(axis=1), top < model.least[own]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per document lang_pred, score and rejected.

    `und` and 0 where the text is null, empty or without a letter, or nothing was learned; rejected is then true.
    Otherwise the language of the nearest centroid, even if rejected. Rows that repeat are each answered.
    """
    more = more or {}
    carried = list(more)
    data = texts(docs, id_col, text_col, *[c.alias(n) for n, c in more.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: languages x centroids x dimensions
    schema = f"doc_id long, {''.join(f'{n} boolean, ' for n in more)}lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            lang, score, rejected = [], [], []
            for first, last, data, offsets in slices(column):
                for at in range(first, last, 256):
                    end = min(last, at + 256)
                    spans = [data[offsets[i - first] : offsets[i - first + 1]] for i in range(at, end)]
                    known = [i for i, s in enumerate(spans) if _has_letter(s)] if model.languages else []
                    names, scores, out = ["und"] * len(spans), [0.0] * len(spans), [True] * len(spans)
                    if known:
                        own, sure, far = predict(model, np.array([gram_counts(spans[i]) for i in known]))
                        for i, o, s, r in zip(known, own, sure, far, strict=True):
                            names[i], scores[i], out[i] = model.languages[o], float(s), bool(r)
                    lang += names
                    score += scores
                    rejected += out
            arrays = [batch.column("doc_id"), *[batch.column(n) for n in carried], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *carried, "lang_pred", "score", "rejected"])

    return data.mapInArrow(run, schema)


def _has_letter(data: np.ndarray) -> bool:
    if (((data | 32) >= 97) & ((data | 32) <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))
