import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import fim, queries

TEXTS = [
    "", "a", "<P> in it", "ab <S", "<M>", "don't stop\n\nÜber straße 日本語 42!! x", "\r\n\t", "🙂a🙂b", "abc" * 50, "a" * 40 + " " + "b" * 3,
    " lead and trail ", "<", "<<P<S<M", "P>S>M>", "é" * 30,
]


def wanted(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    cuts = sorted(x % (len(tokens) + 1) for x in h[:2])
    a, m, z = "".join(tokens[: cuts[0]]), "".join(tokens[cuts[0] : cuts[1]]), "".join(tokens[cuts[1] :])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return doc_id, len(tokens), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


def test_transform_equals_brute_force(documents, odd_rows):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab <PSM>é日🙂\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [*odd_rows, *enumerate(TEXTS, 100), *enumerate(TEXTS, 300), *enumerate(made, 1000)]
    found = fim.transform(documents(rows))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted((wanted(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = {i: t for i, t in rows}
    for r in found.where("doc_id >= 100").select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect():
        assert r.text == texts[r.doc_id]
    assert fim.transform(documents([])).count() == 0


def test_blocks_of_a_long_text_equal_one(prose):
    text = (prose(3000, 1) + "é日🙂" * 100 + "x" * 5000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    place = np.arange(len(text) + 1)
    one, many = fim.Boundaries(data, offsets), fim.Boundaries(data, offsets, 997)
    for bound in fim.OPENS.values():
        assert (one.opened(place, bound) == many.opened(place, bound)).all()
        n = int(one.opened(place[-1:], bound)[0])
        for units in (0, 1, n // 3, n - 1, n):
            args = np.array([0]), np.array([len(text)]), np.array([units]), bound
            assert one.cut(*args) == many.cut(*args)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    assert (one.opened(place, fim.LETTER) == heads).all()


def test_ranks_of_classes():
    values = np.random.default_rng(3).integers(0, 8, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(values)
    for bound in range(8):
        assert (matrix.below(np.arange(1001), bound) == np.concatenate([[0], np.cumsum(values < bound)])).all()


def test_units_of_characters(documents):
    rows = list(enumerate(TEXTS))
    for r in fim.transform(documents(rows), rate=100, unit="character", sentinels=("\x01", "\x02", "\x03")).collect():
        text = TEXTS[r.doc_id]
        assert r.n == len(text) and len(r.output) == len(text) + 3 * (r.form != "plain")
    with pytest.raises(KeyError):
        fim.transform(documents(rows), unit="line")


def test_query_restores_every_text(spark, tmp_path, documents, odd_rows):
    rows = [*odd_rows, *enumerate(TEXTS, 100), (999, "word " * 600_000)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(r.restored_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.output_sha256 for r in got) == sorted(hashlib.sha256(wanted(i, t)[-1].encode()).hexdigest() for i, t in rows)
