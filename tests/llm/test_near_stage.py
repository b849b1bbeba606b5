import inspect
from math import comb

import corpus_pipeline
from gristmill.llm import minhash


def test_stage_links_from_eighty_percent_on(spark, documents):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[: 104 - 20])), (3, " ".join(f"x{i}" for i in range(104))), (4, " ".join(f"x{i}" for i in range(104 - 21)))]
    docs = documents(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == [1, 2, 3, 4]


def test_stated_miss_of_the_query():
    bound = 1.6e-7
    text = f"probability below {bound:.1e}".replace("e-07", "e-7")
    assert sum(comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(minhash.MATCHES)) < bound
    assert text in inspect.getsource(minhash)


def test_matches_keep_the_stated_bound():
    def missed(percent, matches):
        p = percent / 100
        return sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(matches))

    for percent in (50, 80, 85, 95):
        m = minhash.matches_for(percent)
        assert missed(percent, m) <= minhash.MISSED < missed(percent, m + 1)
