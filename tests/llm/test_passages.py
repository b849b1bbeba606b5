import random
import re

import numpy as np
import pytest

from gristmill.llm import linededup
from gristmill.llm.common import KEY_BITS, marked

WORD = re.compile(r"[฀-໿　-鿿]|[^ \t\n\v\f\r฀-໿　-鿿]+")


def brute(rows, min_words):
    """(id, text) without the words of windows that begin at an earlier place, too."""
    last = 1 << 62
    first = {}
    for i, t in sorted(((last if i is None else i, t) for i, t in rows if t), key=lambda r: r[0]):
        first.setdefault(t, i)
    seen, out = set(), {}
    for t, _ in sorted(first.items(), key=lambda r: r[1]):
        spans = [m.span() for m in WORD.finditer(t)]
        w = [t[a:b] for a, b in spans]
        drop = [False] * len(w)
        for p in range(len(w) - min_words + 1):
            window = tuple(w[p : p + min_words])
            if window in seen:
                drop[p : p + min_words] = [True] * min_words
            seen.add(window)
        edges = [*(a for a, _ in spans), len(t)]
        out[t] = t[: edges[0]] + "".join(t[edges[j] : edges[j + 1]] for j in range(len(w)) if not drop[j])
    whole = lambda t: "" if len(WORD.findall(t)) >= min_words else t
    return [(i, whole(t) if t and (last if i is None else i) != first[t] else out[t] if t else t) for i, t in rows]


def made(rng, kind, n):
    if kind == "prose":
        return " ".join(f"{'W' if rng.random() < 0.1 else 'w'}{rng.randrange(300)}{rng.choice(['', '', '', '.', ','])}" for _ in range(n))
    if kind == "lower":
        return " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    if kind == "cyrillic":
        return " ".join("".join(rng.choice("абвгдежз") for _ in range(3)) for _ in range(n))
    return "".join(rng.choice("的一是不了人我在有他這中大来上国" if kind == "han" else "กขคงจฉชซ") for _ in range(n))


@pytest.mark.parametrize(("seed", "min_words"), [(1, 50), (2, 13), (3, 5), (4, 1)])
def test_equals_brute_force(documents, seed, min_words):
    rng = random.Random(seed)
    kinds = ["prose", "lower", "cyrillic", "han", "thai"]
    source = {k: made(rng, k, 600) for k in kinds}
    rows = []
    for i in range(70):
        kind, parts = rng.choice(kinds), []
        for _ in range(rng.randrange(1, 5)):
            s = source[kind]
            spans = [m.span() for m in WORD.finditer(s)]
            a = rng.randrange(len(spans))
            b = min(len(spans), a + rng.choice([min_words - 1, min_words, min_words + 1, 3 * min_words]))
            parts += [s[spans[a][0] : spans[b - 1][1]] if b > a else "", made(rng, kind, rng.randrange(9))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(4)] + [(None, rows[5][1]), (None, None), (200, ""), (201, None), (202, "short"), (203, "short"), rows[7]]
    rows.append((300, "again and again " * 400))
    table = documents(rows)
    found = linededup.dedup_passages(table, min_words)
    assert found.columns == [*table.columns, "n_cut"]
    got = found.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(brute(rows, min_words), key=repr)
    text = {i: t for i, t in rows if i is not None}
    assert all((r.n_cut > 0) == (r.text != text[r.doc_id]) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("kind", ["prose", "lower", "cyrillic", "han"])
def test_passage_that_starts_and_ends_inside_a_line_goes(documents, kind):
    rng = random.Random(9)
    gap = "" if kind == "han" else " "
    passage = made(rng, kind, 51)
    rows = [(i, gap.join([made(rng, kind, 20), f"own{i}", passage, f"end{i}", made(rng, kind, 20)])) for i in range(4)]
    got = {r.doc_id: r.text for r in linededup.dedup_passages(documents(rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == rows[i][1].replace(passage + gap, "") for i in range(1, 4))


def test_texts_of_a_slice_do_not_meet(documents):
    a = [f"a{i}" for i in range(30)]
    b = [f"b{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b))]
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_passages(documents(rows)).collect()) == rows


def test_empty(documents):
    assert linededup.dedup_passages(documents([])).count() == 0


@pytest.mark.parametrize("kind", ["prose", "lower", "cyrillic", "han"])
def test_a_passage_has_the_same_lines_wherever_it_is(kind):
    rng = random.Random(4)
    gap = "" if kind == "han" else " "
    passage = made(rng, kind, 120)
    found = []
    for n in (0, 1, 30, 61):
        text = (made(rng, kind, n) + gap + passage + gap + made(rng, kind, n)).encode()
        data = np.frombuffer(text, np.uint8)
        found.append(set(linededup.Lines(data, np.array([0, len(data)]), 50).ids.tolist()))
    assert len(set.intersection(*found)) >= len(found[0]) - 1 >= 3


def test_ranks_of_doubled_lines_follow_the_order_of_suffixes(spark):
    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(40)] for _ in range(6)]
    rows = [(i, i, p, r, 4) for i, t in enumerate(texts) for p, r in enumerate(t)]
    level = spark.createDataFrame(rows, "id long, sub long, pos int, r long, top int")
    for k in range(3):
        level = linededup.doubled(level, k)
        size = 2 << k
        places = {(i, p): tuple(texts[i][p : p + size]) for i, _, p, *_ in rows if p + size <= 40}
        counts = {v: list(places.values()).count(v) for v in places.values()}
        got = {(r.id, r.pos): r.r for r in level.collect()}
        assert set(got) == {at for at, v in places.items() if counts[v] > 1}
        assert [places[at] for at in sorted(got, key=lambda at: (got[at], places[at]))] == sorted(places[at] for at in got)


def test_candidates_are_one_row_a_text(spark):
    rng = random.Random(6)
    passage = made(rng, "lower", 200)
    rows = [(i, i + 100, f"{made(rng, 'lower', 20)} {passage}", i) for i in range(5)]
    docs = spark.createDataFrame(rows, "id long, sub long, text string, own long")
    none = linededup._pieces(spark, copied=np.zeros((1 << KEY_BITS) // 8, np.uint8))
    searched = linededup.Texts(docs, none, docs.select("id", "sub").limit(0))
    marks = spark.sparkContext.broadcast(linededup._repeated_places(searched, 50))
    found = linededup.candidates(searched, marks, 50).collect()
    assert sorted((r.id, r.sub) for r in found) == [(i, i + 100) for i in range(5)]
    # 151 windows of the passage, and those that hang over its begin but see the same lines.
    assert all(len(r.edges) >= 8 * 151 and len(r.groups) < 4 * 6 * 100 and len(r.line_ids) == len(r.lines) for r in found)


def test_places_of_lines_that_occur_twice_are_marked(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HELD_PLACES", 40)
    rng = random.Random(7)
    passage = made(rng, "lower", 300)
    rows = [(i, i, f"{made(rng, 'prose', 200)} {passage if i % 2 else ''}", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "id long, sub long, text string, own long").repartition(3)
    none = linededup._pieces(spark, copied=np.zeros((1 << KEY_BITS) // 8, np.uint8))
    marks = linededup._repeated_places(linededup.Texts(docs, none, docs.select("id", "sub").limit(0)), 50)
    counts = {}
    for _, _, text, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        for at in linededup.Lines(data, np.array([0, len(data)]), 50).places().tolist():
            counts[at] = counts.get(at, 0) + 1
    twice = {at for at, n in counts.items() if n > 1}
    assert len(twice) > 10 and len(counts) > len(twice) + 50
    assert {at for at in counts if marked(marks, np.array([at]))[0]} == twice
    assert int(np.unpackbits(marks).sum()) == len(twice)


def test_texts_are_numbered_in_order_without_gaps(spark):
    rng = random.Random(8)
    keys = [(rng.randrange(-50, 50), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(500)]
    found = linededup.numbered(spark.createDataFrame(keys, "id long, sub long").repartition(7)).collect()
    assert [(r.id, r.sub) for r in sorted(found, key=lambda r: r.t)] == sorted(keys)
    assert sorted(r.t for r in found) == list(range(500))


def test_bits_of_rows_are_those_of_the_bitmap(spark):
    rng = random.Random(9)
    own = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    place = np.array(own, np.int64).view(np.uint64) >> np.uint64(64 - KEY_BITS)
    marks = np.zeros((1 << KEY_BITS) // 8, np.uint8)
    for at in place[::3].astype(int).tolist():
        marks[at >> 3] |= 128 >> (at & 7)
    rows = spark.createDataFrame(list(enumerate(own)), "i int, own long")
    found = linededup._with_bits(rows, linededup._pieces(spark, some=marks, every=~marks)).orderBy("i").collect()
    want = marked(marks, place).tolist()
    assert [(r.i, r.some, r.every) for r in found] == [(i, w, not w) for i, w in enumerate(want)]
