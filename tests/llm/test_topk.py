import math
import random

from pyspark.sql import functions as F

from gristmill.llm import topk


def brute(rows, k=5):
    floored = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]) for i, v in rows]
    found = []
    for a, (q, u) in enumerate(floored):
        if u is None or q is None or q % 3:
            continue
        scores = [(-sum(x * y for x, y in zip(u, v, strict=True)), math.inf if i is None else i) for b, (i, v) in enumerate(floored) if b != a and v is not None and len(v) == len(u)]
        found += [(q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    monkeypatch.setattr(topk, "BLOCKS_TOGETHER", 2)
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(3, rows[0][1]), (3, rows[1][1]), (None, rows[2][1])]  # ties, copies
    rows += [(300, None), (303, []), (306, []), (309, [1.0, None]), (312, [1.0, math.nan]), (315, [math.inf, 1.0]), (318, [2.0, 1.0]), (321, [1e9, 1e9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "id": F.lit("x"), "rank": F.lit(0)}).repartition(4)
    got = topk.top_products(table, table["vec_id"] % 3 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_elimination_saves_work():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 40, (4000, 8)) + 200 * rng.integers(-1, 2, (4000, 8)))
    pivots = topk.far_points(x[:500], 24)
    far = topk.distances(x, pivots)
    _, scores, evaluated = topk.search_block(x[7], far[7], x, far, np.arange(4000), np.array([7]), None, 5)
    best = np.sort(np.delete(x @ x[7], 7))[::-1][:5]
    assert sorted(scores.tolist(), reverse=True) == best.tolist()
    assert evaluated < 2000


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(table, table["vec_id"] % 3 == 0).count() == 0
