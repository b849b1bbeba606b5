import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gristmill.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs, by holding every lag against every place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                own = words[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 9))]
        several = unit * rng.choice([1, 2, 3, 4, 5, 9])
        words += several[: len(several) - rng.randrange(len(unit))] + [rng.randrange(5) for _ in range(rng.randrange(6))]
    return [f"w{w}" for w in words]


def test_runs_equal_brute_force(documents, odd_rows):
    rng = random.Random(11)
    rows = [*odd_rows, *((100 + k, rng.choice([" ", "\n", " \t"]).join(made(rng))) for k in range(1500))]
    got = periodic.find_runs(documents(rows)).collect()
    assert len(got) == len(rows)
    texts, several = dict(rows), 0
    for r in got:
        if r.doc_id is None or r.doc_id < 100:
            assert not r.runs
            continue
        words = WORD.findall(texts[r.doc_id])
        runs = brute(words)
        several += len(runs)
        assert ([tuple(x) for x in r.runs], r.n_words, r.text) == (runs, len(words), left(words, runs))
    assert several > 1500
    assert periodic.find_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(documents([]), min_periods=2)


def test_nested_splits_and_hidden_periods():
    def runs(text):
        words = text.split()
        ids = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        return periodic.runs_of(ids, np.array([0, len(words)]))[0], brute(words)

    for text in (
        "a a a a a a", "a a a a a", "a b " * 3, "a b " * 4, "a b c " * 4 + "x " + "a b c " * 3, "x a x b x c " * 4,
        "a a a a a a b " * 4, "a b a b a b a b c " * 5, "x y z " * 40 + "x y y z " * 9, "a b b a " * 4 + "a b b a c " * 4,
    ):
        found, expected = runs(text)
        assert found == expected, text


def test_blocks_of_a_long_text(prose, monkeypatch):
    text = " \n".join([prose(500, 3), "one two three " * 200, "x" * 3000, prose(300, 4)]).encode()
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, len(text)])
    whole, at = periodic.words_of(data, offsets)
    runs = periodic.runs_of(whole, at)[0]
    assert runs == brute(text.split()) and runs
    monkeypatch.setattr(periodic, "SLICE_BYTES", 100)
    parted, at = periodic.words_of(data, offsets)
    assert (parted == whole).all() and at.tolist() == [0, len(whole)]
    assert periodic.collapsed(data, runs).decode() == left(text.decode().split(), runs)


def test_long_periods():
    words = np.arange(400_000, dtype=np.uint64) % np.uint64(70_001)
    words[:1000] += np.uint64(1 << 40)
    assert periodic.runs_of(words, np.array([0, len(words)])) == [[(1000, 399_000, 70_001)]]
    same = np.zeros(100_000, np.uint64)
    assert periodic.runs_of(same, np.array([0, 60_000, 100_000])) == [[(0, 60_000, 1)], [(0, 40_000, 1)]]


def test_query_equals_brute_force(spark, tmp_path, documents, odd_rows, prose):
    rows = [*odd_rows, *((100 + k, prose(k, k, 50)) for k in range(300)), (5000, "a b\n" * 30), (5001, "x " * 5)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), left(words, runs))]
        expected.append((i, len(runs), *first, *hashes))
    got = [tuple(r) for r in queries.op12_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 10
