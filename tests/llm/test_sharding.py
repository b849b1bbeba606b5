import zlib
from collections import Counter

import pytest

from gristmill.llm.sharding import shard

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_rows_slots_and_growth(spark, documents, odd_rows, monkeypatch):
    from gristmill.llm import sharding

    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 3)
    rows = odd_rows + [(i, f"text {i}") for i in range(100, 700)] + [(9, "copy")] * 20
    found = shard(documents(rows), [1.0] * 7)
    assert found.columns == COLUMNS
    got = found.collect()
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 7) for r in got)
    assert 40 < sum(r.grown_shard == 7 for r in got) < 150
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in (6, 9, None))


def test_weights(spark, documents):
    rows = [(i, "t") for i in range(4000)]
    n = Counter(r.shard for r in shard(documents(rows), [1.0, 3.0, 0.0]).collect())
    assert 2 not in n and 2.5 < n[1] / n[0] < 3.6
    with pytest.raises(ValueError):
        shard(documents(rows), [0.0])


def test_empty(documents):
    assert shard(documents([])).count() == 0
