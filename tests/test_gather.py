from collections import Counter

import pytest

import gristmill as g
from gristmill.plans.gather import choose_key, overlap_scores, shared_columns


def scores(tables):
    return dict(overlap_scores(tables, shared_columns(tables)).collect())


def test_shared_names_ignore_case_and_spaces(spark):
    a = spark.createDataFrame([(1, 1, 1)], "Order_ID int, x int, ` b` int")
    b = spark.createDataFrame([(1, 1, 2)], "order_id int, y int, B int")
    assert shared_columns([a, b]) == ["Order_ID", " b"]
    assert shared_columns([]) == []


def test_overlap_of_values(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert scores([a, b])["k"] == pytest.approx(2 / 3)


def test_overlap_ignores_case_spaces_and_number_types(spark):
    a = spark.createDataFrame([(" Ab", 1.0), ("C", None)], "t string, n double")
    b = spark.createDataFrame([("aB ", 1), ("d", 2)], "t string, n int")
    assert scores([a, b]) == {"t": 0.5, "n": pytest.approx(0.75)}


def test_overlap_with_any_other_table(spark):
    a, b, c = (spark.createDataFrame([(v,) for v in vs], "k int") for vs in ((1, 2), (2, 3), (1, 9)))
    assert scores([a, b, c])["k"] == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_overlap_of_more_tables_than_a_whole_number_has_bits(spark):
    tables = [spark.range(i, i + 2).toDF("k") for i in range(70)]
    assert scores(tables)["k"] == pytest.approx((68 * 1 + 2 * 0.5) / 70)


def test_a_table_without_values_means_no_overlap(spark):
    a = spark.createDataFrame([(1,)], "k int")
    assert scores([a, spark.createDataFrame([(None,)], "k int")])["k"] == 0.0
    assert choose_key([a.limit(0), a.limit(0)]) == (None, 0.0)


def test_same_names_without_same_values_are_no_key(spark):
    a = spark.createDataFrame([("foo", 1), ("bar", 2)], "notes string, id int")
    b = spark.createDataFrame([("baz", 9), ("qux", 8)], "notes string, id int")
    key, score = choose_key([a, b])
    assert key is None and score < 0.3


def test_first_column_wins_a_tie(spark):
    a = spark.createDataFrame([(1, 1)], "b int, a int")
    assert choose_key([a, a])[0] == "b"


def test_outer_join_on_the_key(spark):
    sales = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "order_id int, amount int")
    cost = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "order_id int, ship int")
    result = g.gather({"sales.csv": sales, "cost.csv": cost})
    assert result.joined.columns == ["order_id", "amount", "ship"]
    assert sorted(map(tuple, result.joined.collect()), key=lambda r: r[0]) == [
        (1, 10, None), (2, 20, 1), (3, 30, 2), (4, None, 3),
    ]
    row = result.summary.first()
    assert (row["mode"], row["join_column"], row["overlap_score"], row["final_row_count"]) == ("joined", "order_id", 0.667, 4)
    assert [tuple(r) for r in result.rows_per_input.collect()] == [("sales.csv", 3), ("cost.csv", 3)]


def test_key_spelled_differently_keeps_its_values(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "Key int, v int")
    b = spark.createDataFrame([(2, 5), (3, 6)], "key int, v int")
    joined = g.gather({"a.csv": a, "b.csv": b}).joined
    assert joined.columns == ["Key", "v", "v_b"]
    assert sorted(map(tuple, joined.collect())) == [(1, 1, None), (2, 2, 5), (3, None, 6)]


def test_null_keys_meet_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r")], "k int, b string")
    joined = g.gather({"a": a, "b": b}).joined
    assert Counter(map(tuple, joined.collect())) == Counter([(1, "x", "p"), (None, "y", "q"), (None, "y", "r")])


def test_numbers_meet_text_keys(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "k double, a string")
    b = spark.createDataFrame([("1", "p"), ("z", "q")], "k string, b string")
    joined = g.gather({"a": a, "b": b}).joined
    assert Counter(map(tuple, joined.collect())) == Counter([("1", "x", "p"), ("2", "y", None), ("z", None, "q")])


def test_tables_without_a_key_stay_apart(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(2,)], "b int")
    result = g.gather({"first.csv": a, "second.csv": b, "deep/" + "x" * 40 + ".csv": a, "first.json": b})
    assert result.mode == "apart" and result.joined is None and result.reason
    assert list(result.tables) == ["first", "second", ("deep/" + "x" * 40)[:31], "first_2"]


def test_one_table_is_not_enough(spark):
    with pytest.raises(ValueError):
        g.gather({"a": spark.range(3)})


def test_too_large_a_join_is_refused(spark):
    a = spark.createDataFrame([("x",)] * 30, "kind string")
    result = g.gather({"a": a, "b": a}, max_fanout=500)
    assert result.fanout.first()["rows"] == 900
    with pytest.raises(ValueError, match="900"):
        result.joined


def brute_force(tables):
    """Left-to-right full outer join of (key, value) rows, null equal to null."""
    joined = [(k, (v,)) for k, v in tables[0]]
    for width, right in enumerate(tables[1:], start=1):
        keys_left, keys_right = {k for k, _ in joined}, {k for k, _ in right}
        joined = (
            [(k, (*vs, w)) for k, vs in joined for q, w in right if q == k]
            + [(k, (*vs, None)) for k, vs in joined if k not in keys_right]
            + [(q, (*[None] * width, w)) for q, w in right if q not in keys_left]
        )
    return Counter((k, *vs) for k, vs in joined)


def test_hot_keys_join_as_any_other(spark, tiny_limits):
    a = [(1, i) for i in range(40)] + [(2, i) for i in range(30)] + [(k, k) for k in range(10, 30)] + [(None, 7)] * 8
    b = [(1, 100 + i) for i in range(3)] + [(4, i) for i in range(25)] + [(k, -k) for k in range(20, 40)] + [(None, 9)]
    c = [(1, 5)] + [(k, k) for k in (2, 4, 25, 50)] + [(25, 1)] * 20
    tables = {n: spark.createDataFrame(rows, f"k int, {n} int") for n, rows in zip("abc", (a, b, c))}
    result = g.gather(tables, min_overlap=0.0)
    expected = brute_force([a, b, c])
    assert Counter(map(tuple, result.joined.collect())) == expected
    assert [r["rows"] for r in result.fanout.collect()] == [sum(brute_force([a, b]).values()), sum(expected.values())]


def test_keys_of_different_types(spark):
    from decimal import Decimal

    a = spark.createDataFrame([(Decimal(12345678901234567890),), (Decimal(12345678901234567891),)], "k decimal(20,0)")
    b = spark.createDataFrame([(Decimal("12345678901234567891.00"), "x")], "k decimal(24,2), v string")
    joined = g.gather({"a": a, "b": b}).joined.collect()
    assert sorted((int(r["k"]), r["v"]) for r in joined) == [(12345678901234567890, None), (12345678901234567891, "x")]
    whole = spark.createDataFrame([(1234567890123456,)], "k long")
    double = spark.createDataFrame([(1234567890123456.0,), (None,)], "k double")
    assert scores([whole, double])["k"] == 1.0
    days = spark.sql("SELECT DATE'2024-01-05' AS d UNION ALL SELECT DATE'2024-01-06'")
    moments = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-05 00:00:00' AS d, 7 AS n")
    assert scores([days, moments])["d"] == 0.75
    assert g.gather({"a": days, "b": moments}).joined.count() == 2


@pytest.mark.parametrize("bits", [14, 5])
def test_sketches_of_many_columns_lead_to_the_exact_choice(spark, monkeypatch, bits):
    from gristmill.plans import gather as plan

    monkeypatch.setattr(plan, "SKETCH_BITS", bits)
    ids = spark.range(3000)
    shifts = [(37 * j + 11) % 20 for j in range(40)]  # columns 20 apart tie
    tables = [ids.selectExpr(*[f"cast(id + {t * 30 * s} as string) k{j}" for j, s in enumerate(shifts)], "null as none") for t in range(3)]
    columns = shared_columns(tables)
    possible = plan.possible_keys(tables, columns)
    best = [f"k{j}" for j, s in enumerate(shifts) if s == 0]
    assert set(best) <= set(possible) and (len(possible) <= 3 or bits == 5)
    exact = dict(overlap_scores(tables, columns).collect())
    assert choose_key(tables) == (best[0], exact[best[0]]) == (best[0], 1.0)
