"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word is the mean of hashed embeddings of itself, its first three to five and its last three and four bytes, so
that unseen forms of a known stem are near it. Filters one, two and three words wide run over the whole text; the
largest output of each filter feeds a logistic layer. Passes over all labelled rows, learners side by side, train it.
Thresholds are set per language on rows kept back from the training; the language is read off the text's own function
words, never off a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM, LOWER, Scratch, bounded_sample, few_rows, mix, ship, slices, sorted_groups, span_hashes, text_hash, texts, tidy, word_spans

BUCKETS = 1 << 15
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: The start is fitted on a sample of so many texts of each label and so many bytes, at most.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 20_000_000
#: Share of the sample kept back for the thresholds.
KEPT_BACK = 0.25
#: With fewer texts of a label no threshold is told from them.
FEW = 25
EPOCHS = 14
#: Rates of the passes over all labelled texts, made by learners of about so many texts each.
PASSES = (0.008, 0.004)
LEARNER_ROWS = 8_000
BATCH = 16
#: Buckets of the table that are averaged together; bins of logits, per one, in which the thresholds are told.
BLOCK = 1 << 10
BINS = 64

#: Function words that tell languages apart; texts with none of them get the threshold of all languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on are as be this by from or",
    "de": "der die und das den von zu mit sich des auf für ist nicht ein eine dem im auch",
    "fr": "le la les des et est une du dans qui que pour pas au sur par plus ne avec",
    "es": "el los las y del una por con para su al lo como más pero sus este ya",
}


class Batch(NamedTuple):
    """Hashed features of the words of some texts, and where each text begins (one more entry at the end)."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Batch:
    """The six hashed features of each word of a slice of texts."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, ALNUM)
    words = span_hashes(low, starts, ends)
    out = np.empty((len(starts), 6), np.int32)
    out[:, 0] = words >> np.uint64(49)
    for j, n in enumerate((3, 4, 5)):
        part = span_hashes(low, starts, np.minimum(starts + n, ends))
        out[:, 1 + j] = mix(part + np.uint64(n)) >> np.uint64(49)
    for j, n in enumerate((3, 4)):
        part = span_hashes(low, np.maximum(ends - n, starts), ends)
        out[:, 4 + j] = mix(part + np.uint64(16 + n)) >> np.uint64(49)
    return Batch(out, words, first)


class Model(NamedTuple):
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shifts: dict[str, float]
    scale: float


_WORD_LANGUAGE = {
    int(span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]): lang
    for lang, words in FUNCTION_WORDS.items()
    for w in words.split()
}
_KNOWN = np.array(sorted(_WORD_LANGUAGE), np.uint64)
_LANGUAGES = list(FUNCTION_WORDS)
_KNOWN_LANGUAGE = np.array([_LANGUAGES.index(_WORD_LANGUAGE[int(h)]) for h in _KNOWN])


def languages(batch: Batch) -> list[str]:
    """Per text the language with most function words in it; "" without any."""
    at = np.minimum(np.searchsorted(_KNOWN, batch.words), len(_KNOWN) - 1)
    hit = np.flatnonzero(_KNOWN[at] == batch.words)
    counts = np.zeros((len(batch.first) - 1, len(_LANGUAGES)), np.int64)
    text = np.searchsorted(batch.first, hit, "right") - 1
    np.add.at(counts, (text, _KNOWN_LANGUAGE[at[hit]]), 1)
    return [_LANGUAGES[int(np.argmax(c))] if c.any() else "" for c in counts]


def _embed(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    v = table[features[:, 0]].copy()
    for j in range(1, features.shape[1]):
        v += table[features[:, j]]
    return v * np.float32(1 / features.shape[1])


def pooled(model: Model, batch: Batch, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest output of each filter over each text (0 without words), and where it is."""
    n = len(batch.first) - 1
    v = _embed(model.table, batch.features)
    width = max(WIDTHS) - 1
    v = np.concatenate([v, np.zeros((width, v.shape[1]), np.float32)])
    full = np.flatnonzero(np.diff(batch.first) > 0)
    best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    place = np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
    text_end = np.repeat(batch.first[1:], np.diff(batch.first))
    at = np.arange(len(batch.features))
    for k, w in enumerate(WIDTHS):
        out = v[: len(at)] @ model.filters[k][0]
        for j in range(1, w):
            inside = (at + j < text_end)[:, None]
            out += np.where(inside, v[j : len(at) + j] @ model.filters[k][j], 0)  # zeros beyond the text's end
        if len(full):
            best[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(out, batch.first[full], axis=0)
        if where:
            for i in full:
                a, b = batch.first[i], batch.first[i + 1]
                place[i, k * FILTERS : (k + 1) * FILTERS] = a + np.argmax(out[a:b], axis=0)
    return best, place


def _logits(model: Model, batch: Batch) -> np.ndarray:
    best, _ = pooled(model, batch)
    return np.maximum(best + model.bias, 0) @ model.out + model.out_bias


def _batches(sample: list[str], rows: np.ndarray, size: int) -> Iterator[tuple[Batch, np.ndarray]]:
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        data = [sample[j].encode() for j in part]
        offsets = np.cumsum([0, *map(len, data)])
        yield features(np.frombuffer(b"".join(data), np.uint8), offsets), part


class Trainer:
    """The parameters of a model and the state of their optimizer: Adam, and AdaGrad for the table."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self._moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in parts.items() if k != "table"}
        self.squares = np.zeros(BUCKETS, np.float32)
        self._steps = 0

    @classmethod
    def on(cls, m: Model) -> Trainer:
        """One that goes on from a model."""
        filters = {f"f{k}": f.copy() for k, f in enumerate(m.filters)}
        return cls({"table": m.table.copy(), **filters, "bias": m.bias.copy(), "out": m.out.copy(), "end": np.array([m.out_bias], np.float32)})

    def model(self, shifts: dict[str, float] | None = None, scale: float = 1.0) -> Model:
        p = self.parts
        return Model(p["table"], [p[f"f{k}"] for k in range(len(WIDTHS))], p["bias"], p["out"], float(p["end"][0]), shifts or {}, scale)

    def dense(self) -> np.ndarray:
        """All parameters but the table."""
        return np.concatenate([self.parts[k].ravel() for k in self._moments])

    def add(self, change: np.ndarray) -> None:
        """Change all parameters but the table."""
        first = 0
        for k in self._moments:
            p = self.parts[k]
            p += change[first : first + p.size].reshape(p.shape)
            first += p.size

    def step(self, batch: Batch, y: np.ndarray, rate: float) -> None:
        """Learn from the texts of a batch and their labels."""
        m, parts = self.model(), self.parts
        best, place = pooled(m, batch, where=True)
        active = np.maximum(best + m.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ m.out + m.out_bias, -30, 30)))
        error = (p - y) / len(y)
        grads = {"end": np.array([error.sum()], np.float32), "out": active.T @ error + 1e-4 * m.out}
        back = error[:, None] * m.out[None, :] * (best + m.bias > 0)
        full = np.diff(batch.first) > 0
        grads["bias"] = back.sum(axis=0)
        back = back * full[:, None]
        touched, changes = [], []
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g = np.zeros_like(m.filters[k])
            for j in range(w):
                at = place[:, own] + j
                ok = (at < batch.first[1:][:, None]) & (back[:, own] != 0)
                i, f = np.nonzero(ok)
                if not len(i):
                    continue
                words = batch.features[at[i, f]]
                weight = back[:, own][i, f]
                np.add.at(g[j].T, f, weight[:, None] * _embed(m.table, words))
                touched.append(words)
                changes.append(weight[:, None] * m.filters[k][j].T[f])
            grads[f"f{k}"] = g
        self._steps += 1
        for name, g in grads.items():
            a, v = self._moments[name]
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            parts[name] -= (rate * (a / (1 - 0.9**self._steps)) / (np.sqrt(v / (1 - 0.999**self._steps)) + 1e-7)).astype(np.float32)
        if touched:
            where, which = np.unique(np.concatenate(touched), return_inverse=True)
            change = np.concatenate(changes)
            g = np.zeros((len(where), SIZE), np.float32)
            for j in range(6):
                np.add.at(g, which.reshape(-1, 6)[:, j], change / 6)
            self.squares[where] += (g * g).mean(axis=1)
            parts["table"][where] -= 4 * rate * g / (np.sqrt(self.squares[where]) + 1e-6)[:, None]


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model from (text, 0 or 1) pairs; with one label only, or none, its score is a constant."""
    rng = np.random.default_rng(seed)
    texts_ = [t for t, _ in sample]
    y = np.array([int(v) for _, v in sample], np.float32)
    total = len(WIDTHS) * FILTERS
    parts = {"table": rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32)}
    for k, w in enumerate(WIDTHS):
        parts[f"f{k}"] = rng.normal(0, 0.5 / w, (w, SIZE, FILTERS)).astype(np.float32)
    parts |= {"bias": np.zeros(total, np.float32), "out": rng.normal(0, 0.3, total).astype(np.float32), "end": np.zeros(1, np.float32)}
    trainer = Trainer(parts)
    if len(set(y.tolist())) < 2:
        parts["out"][:] = 0
        parts["end"][0] = 2.0 if len(y) and y[0] else -2.0
        return trainer.model({"": 0.0})
    order = rng.permutation(len(y))
    kept, used = order[: int(len(y) * KEPT_BACK)], order[int(len(y) * KEPT_BACK) :]
    # The features are the same in each epoch; small batches of texts of like length keep them cheap.
    used = used[np.argsort([len(texts_[i]) for i in used], kind="stable")]
    prepared = list(_batches(texts_, used, BATCH))
    for epoch in range(epochs):
        rate = 0.02 * (0.5 if epoch >= epochs // 2 else 1.0) * (0.4 if epoch >= epochs * 3 // 4 else 1.0)
        for b in rng.permutation(len(prepared)):
            batch, rows = prepared[b]
            trainer.step(batch, y[rows], rate)
    return trainer.model(_thresholds(trainer.model(), texts_, y, kept if len(set(y[kept].tolist())) == 2 else order))


def _thresholds(m: Model, texts_: list[str], y: np.ndarray, rows: np.ndarray) -> dict[str, float]:
    logits, names = np.zeros(len(rows)), []
    for i, (batch, part) in enumerate(_batches(texts_, rows, 64)):
        logits[i * 64 : i * 64 + len(part)] = _logits(m, batch)
        names += languages(batch)
    return _shifts(logits, np.array(names), y[rows] > 0.5, np.ones(len(rows), np.int64))


def _shifts(logits: np.ndarray, names: np.ndarray, truth: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Per language the logit that parts the labels best; languages with few rows of a label get that of all.

    Each entry stands for n texts of a language, a label and a logit.
    """

    def best(pick: np.ndarray) -> float:
        x, at = np.unique(logits[pick], return_inverse=True)
        t = np.bincount(at, np.where(truth, n, 0)[pick], len(x))
        f = np.bincount(at, np.where(truth, 0, n)[pick], len(x))
        # Errors if all from place i on are called toxic, each label weighted alike.
        missed = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
        false = (f.sum() - np.concatenate([[0], np.cumsum(f)])) / max(1, f.sum())
        cost = missed + false
        i = np.flatnonzero(cost <= cost.min() + 1e-9)
        edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
        low, high = edges[i[0]], edges[i[-1] + 1]
        return float((low + high) / 2)

    shifts = {"": best(np.ones(len(n), bool))}
    for lang in _LANGUAGES:
        pick = names == lang
        if min(n[truth & pick].sum(), n[~truth & pick].sum()) >= FEW:
            shifts[lang] = best(pick)
    return shifts


def fit_all(rows: DataFrame) -> Model:
    """A model from all rows (doc_id, text, label 0 or 1); nulls are left out.

    It starts from one fitted on a bounded sample. Learners, each with a share of the rows, then go over all of them but
    those kept back, and what they changed is averaged after each pass. The thresholds come from all rows kept back; where
    these are few of a label, none is kept back.
    """
    ship(rows.sparkSession)
    tables = Scratch(rows.sparkSession)
    h = text_hash(F.col("text"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    columns = ("text", F.col("label").cast("int").alias("label"), h.alias("h"), F.octet_length("text").alias("n"), F.xxhash64("doc_id", h).alias("own"))
    rows = tables.write(rows.select(*columns))
    tidy(rows.sparkSession)
    back = F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * KEPT_BACK)  # copies of a text are all kept back or none
    counts = {(r["back"], r["label"]): r["count"] for r in rows.groupBy(back.alias("back"), "label").count().collect()}
    held = all(counts.get((False, label), 0) and counts.get((True, label), 0) >= FEW for label in (0, 1))
    used, judged = (rows.where(~back), rows.where(back)) if held else (rows, rows)
    n = sum(c for (side, _), c in counts.items() if not (held and side))
    model = fit(bounded_sample(used.select("label", "h", "n"), used.select("text"), SAMPLE_ROWS, SAMPLE_BYTES))
    if len({label for _, label in counts}) > 1:
        for k, rate in enumerate(PASSES):
            model = _passed(used, model, -(-n // LEARNER_ROWS), k, rate)
        model = model._replace(shifts=_thresholds_of(judged, model))
    tables.delete()
    return model


def _passed(rows: DataFrame, model: Model, learners: int, k: int, rate: float) -> Model:
    """The model after pass k: each learner goes over its rows, and the changes are averaged, those of the table over
    the learners that touched a bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size
    # By the document and the text, so that copies of a text are dealt out, too.
    dealt = rows.select("text", "label", F.pmod("own", F.lit(learners)).cast("int").alias("learner"), F.xxhash64("own", F.lit(k)).alias("turn"))
    dealt = dealt.repartition(learners, "learner").sortWithinPartitions("learner", "turn")

    def changes(learner: int, trainer: Trainer, n: int) -> Iterator[pa.RecordBatch]:
        start = Trainer.on(shared.value)
        moved, touched = trainer.parts["table"] - start.parts["table"], trainer.squares > 0
        blocks = [(-1, trainer.dense() - start.dense(), np.ones(0, bool))]
        blocks += [(i, moved[i : i + BLOCK], touched[i : i + BLOCK]) for i in range(0, BUCKETS, BLOCK)]
        for i, values, marks in blocks:
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "learner": pa.array([learner], pa.int32()), "n": pa.array([n], pa.int64()), "change": [values.tobytes()], "touched": [marks.tobytes()]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, own, n = None, -1, 0
        for batch in batches:
            of, y = np.asarray(batch.column("learner")), np.asarray(batch.column("label")).astype(np.float32)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and of[a] != own:
                    if trainer is not None:
                        yield from changes(own, trainer, n)
                    trainer, own, n = Trainer.on(shared.value), int(of[a]), 0
                for i in range(a, b, BATCH):
                    end = min(i + BATCH, b)
                    for top, last, data, offsets in slices(batch.column("text").slice(i, end - i), 1 << 19):
                        trainer.step(features(data, offsets), y[i + top : i + last], rate)
                n += b - a
        if trainer is not None:
            yield from changes(own, trainer, n)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "block"):
            total = weight = 0.0
            for n, change, touched in zip(*(group.column(c).to_pylist() for c in ("n", "change", "touched")), strict=True):
                marks = np.frombuffer(touched, bool)
                own = n * (marks if len(marks) else np.ones(1)).astype(float)[:, None]
                total = total + own * np.frombuffer(change, np.float32).reshape(len(own), -1)
                weight = weight + own
            yield pa.RecordBatch.from_pydict({"block": group.column("block").slice(0, 1).combine_chunks(), "change": [(total / np.maximum(weight, 1)).astype(np.float32).tobytes()]})

    moved = dealt.mapInArrow(learn, "block int, learner int, n long, change binary, touched binary")
    found = moved.repartition("block").sortWithinPartitions("block", "learner").mapInArrow(mean, "block int, change binary").collect()
    trainer = Trainer.on(model)
    for r in found:
        change = np.frombuffer(r["change"], np.float32)
        if r["block"] < 0:
            trainer.add(change)
        else:
            trainer.parts["table"][r["block"] : r["block"] + BLOCK] += change.reshape(-1, SIZE)
    tidy(rows.sparkSession)
    return trainer.model()


def _thresholds_of(rows: DataFrame, model: Model) -> dict[str, float]:
    """Thresholds from all rows, by counts of logits in bins of a fixed number."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, end, data, offsets in slices(batch.column("text"), 1 << 19):
                found = features(data, offsets)
                bins = np.clip(np.rint(_logits(shared.value, found) * BINS), -64 * BINS, 64 * BINS).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(languages(found), pa.string()), "label": batch.column("label").slice(top, end - top), "bin": pa.array(bins)})

    counted = rows.select("text", "label").mapInArrow(run, "lang string, label int, bin int").groupBy("lang", "label", "bin").count().collect()
    columns = [np.array([r[c] for r in counted]) for c in ("bin", "lang", "label", "count")]
    return _shifts(columns[0] / BINS, columns[1], columns[2] == 1, columns[3])


def scores(model: Model, batch: Batch) -> np.ndarray:
    """Between 0 and 1; from 0.5 on a text is called toxic. Each language has a threshold of its own."""
    x = _logits(model, batch)
    shift = np.array([model.shifts.get(lang, model.shifts[""]) for lang in languages(batch)])
    return 1 / (1 + np.exp(-np.clip((x - shift) * model.scale, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per document score and predicted, from its whole text. Null and empty texts are scored as texts without words.

    more: columns to carry along by name (long, string or boolean). Rows that repeat are each answered.
    """
    more = more or {}
    carried = list(more)
    data = texts(docs, id_col, text_col, *[c.alias(n) for n, c in more.items()])
    kinds = dict(data.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the table and the filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [scores(model, features(data, offsets)) for _, _, data, offsets in slices(batch.column("text"), 1 << 19)]
            p = np.concatenate([*found, np.zeros(0)])
            arrays = [batch.column("doc_id"), *[batch.column(n) for n in carried], pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *carried, "score", "predicted"])

    return data.mapInArrow(run, f"doc_id long, {''.join(f'`{n}` {kinds[n]}, ' for n in more)}score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, whose score is below 0.5."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [scores(shared.value, features(data, offsets)) for _, _, data, offsets in slices(batch.column("row").field(text), 1 << 19)]
            yield batch.filter(pa.array(np.concatenate([*found, np.zeros(0)]) < 0.5))

    return own.mapInArrow(run, own.schema).select("row.*")
