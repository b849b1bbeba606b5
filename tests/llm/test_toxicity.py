import random

import numpy as np

from gristmill.llm import toxicity


def made(seed, toxic):
    rng = random.Random(seed)
    words = [f"{rng.choice(['the', 'and', 'der', 'und', 'les', 'las'])}{rng.choice(['', 'on', 'er', 'ti'])}" for _ in range(rng.randrange(20, 80))]
    if toxic:
        words[rng.randrange(len(words))] = rng.choice(["vilestuff", "vilething", "nastyone"])
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(documents, odd_rows):
    model = toxicity.fit([(made(i, i % 3 == 0), int(i % 3 == 0)) for i in range(900)])
    rows = [(i, made(10_000 + i, i % 3 == 0)) for i in range(300)] + [(900, made(1, False) * 3_000 + " vilething"), *odd_rows]
    got = toxicity.score(documents(rows), model).collect()
    assert len(got) == len(rows)
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and 6 < r.doc_id < 300]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert next(r.predicted for r in got if r.doc_id == 900) == 1
    kept = toxicity.without_toxic(documents(rows), model)
    assert kept.columns == documents(rows).columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_unseen_form_of_a_stem():
    model = toxicity.fit([(made(i, i % 3 == 0), int(i % 3 == 0)) for i in range(900)])
    data = b"the and der vilestthing und les"
    batch = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert toxicity.scores(model, batch)[0] >= 0.5


def test_one_label_or_none(documents):
    for sample, predicted in (([], 0), ([("a b", 1)] * 5, 1), ([("a b", 0)] * 5, 0)):
        model = toxicity.fit(sample)
        assert [r.predicted for r in toxicity.score(documents([(1, "a b")]), model).collect()] == [predicted]
    assert toxicity.score(documents([]), toxicity.fit([])).count() == 0


def test_all_labelled_rows_are_learned_from(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 12)
    monkeypatch.setattr(toxicity, "LEARNER_ROWS", 700)
    seen, passed = [], toxicity._passed

    def counted(rows, *more):
        seen.append(rows.count())
        return passed(rows, *more)

    monkeypatch.setattr(toxicity, "_passed", counted)
    bad = [f"{a}{b}" for a in ("vile", "nasty", "gross", "fouly") for b in ("stuff", "thing", "pile", "heap")]

    def text(i):
        return f"{made(i, False)} {bad[i % 16] if i % 3 == 0 else 'plain'} {made(i + 50_000, False)}"

    rows = [(i, text(i), int(i % 3 == 0)) for i in range(2_000)] + [(9_000, None, 1), (9_001, "", 0), (None, "the", 0), (9_002, "the", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    few = toxicity.fit([(t, label) for _, t, label in rows[:24]])
    model = toxicity.fit_all(table)
    # Each pass goes over all rows but the quarter kept back.
    assert len(seen) == len(toxicity.PASSES) and min(seen) > 0.7 * 2_000
    asked = [(i, text(20_000 + i)) for i in range(600)]
    right = [
        np.mean([r.predicted == int((20_000 + r.doc_id) % 3 == 0) for r in toxicity.score(documents(asked), m).collect()])
        for m in (few, model)
    ]
    assert right[1] > 0.95 and right[1] > right[0]


def test_all_rows_of_one_label_or_none(spark, documents):
    for rows, predicted in (([], 0), ([(1, "a b", 1)], 1), ([(1, "a b", 0)], 0)):
        model = toxicity.fit_all(spark.createDataFrame(rows, "doc_id long, text string, label int"))
        assert [r.predicted for r in toxicity.score(documents([(1, "a b")]), model).collect()] == [predicted]
