import random
import re

import numpy as np
import pytest

from gristmill.llm import minhash
from gristmill.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    shingles = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return sorted(((doc, len(shingles[i]), smallest.get(find(i)) if shingles[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed, odd_rows):
    rng = random.Random(seed)
    rows = list(odd_rows)
    for base in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150]))]
        for k in range(rng.choice([2, 5, 30])):
            rows.append((100 * (base + 1) + k, " ".join(edited(rng, words, rng.choice([0, 0.005, 0.01, 0.03])))))
    for i in range(40):
        rows.append((1000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60)))))
    return [*rows, (2000, rows[20][1].upper()), (2001, rows[20][1].replace(" ", "\n ")), (2002, "a b c"), (2003, "A  b c"), (2004, "x " * 30_000)]


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(documents, odd_rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = corpus(5, odd_rows)
    got = minhash.near_duplicates(documents(rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.kept == (r.doc_id == r.component_id)
    table = documents(rows)
    kept = minhash.one_of_each(table)
    assert kept.columns == table.columns
    want = {(r.doc_id, r.n_shingles) for r in got if r.kept}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in want if i is not None)


def test_threshold_is_met_exactly(documents):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[: 104 - 15])), (3, " ".join(words[: 104 - 16]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows[:2])).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents([rows[0], rows[2]])).collect()}
    assert got == {1: 1, 3: 3}


def test_matches_are_rarely_missed():
    from math import comb

    p = sum(comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(minhash.MATCHES))
    assert p < 1e-6


def test_comparisons_agree():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 300, np.uint64)
    some = [np.unique(rng.choice(base, rng.integers(1, 250))) for _ in range(20)]
    got = minhash.similar(50)([s.tobytes() for s in some], None)
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            inter = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * inter >= 50 * (len(a) + len(b) - inter))
    across = minhash.similar(50)([s.tobytes() for s in some[:7]], [s.tobytes() for s in some[7:]])
    assert (across == got[:7, 7:]).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
