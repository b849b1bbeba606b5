"""Row checks and the whole of clean."""

import pytest
from pyspark.sql import functions as F

import gristmill as g

CUSTOMERS = [
    (1, "John Smith", "North", 100.50, "2024-01-05", "M"),
    (2, "jane doe", "south", 200.00, "01/06/2024", "Male"),
    (2, "Jane Doe", "South", 200.00, "-", "Female"),
    (3, "Bob Lee", "North", 150.75, None, "f"),
    (4, None, None, None, None, None),
    (5, "Mike Ross", "East", None, None, "f"),
]
SCHEMA = "customer_id bigint, name string, region string, amount double, signup_date string, gender string"


def test_six_customers(frame, rows_of):
    result = g.clean(frame(CUSTOMERS, SCHEMA))
    assert result.counts == {
        "original_row_count": 6,
        "empty_rows_removed": 1,
        "rows_with_missing_values": 3,
        "duplicate_rows_removed": 0,
        "conflicting_duplicate_rows": 2,
        "final_row_count": 5,
    }
    assert rows_of(result.cleaned) == [
        (1, "John Smith", "North", 100.5, "2024-01-05", "Male"),
        (2, "jane doe", "south", 200.0, "2024-01-06", "Male"),
        (2, "jane doe", "south", 200.0, "Unknown", "Female"),
        (3, "Bob Lee", "North", 150.75, "Unknown", "Female"),
        (5, "Mike Ross", "East", 175.375, "Unknown", "Female"),
    ]
    reason = "Same customer_id as another row, but differs in: signup_date, gender"
    assert rows_of(result.conflicts) == [(reason, *CUSTOMERS[1]), (reason, *CUSTOMERS[2])]
    assert rows_of(result.empty) == [("All fields empty except the ID", *CUSTOMERS[4])]
    assert [r[0] for r in rows_of(result.missing)] == [
        "Missing values in: signup_date",
        "Missing values in: signup_date",
        "Missing values in: amount, signup_date",
    ]
    assert rows_of(result.duplicates) == []


def test_four_customers_left(frame):
    rows = [
        (1, "North", 100.0, "M"), (2, "south", 200.0, "Male"), (2, "South", 200.0, "Female"),
        (3, "South", None, "f"), (4, None, None, None), (4, None, None, None),
    ]
    result = g.clean(frame(rows, "customer_id int, region string, amount double, gender string"))
    assert result.counts["empty_rows_removed"] == 2
    assert result.counts["conflicting_duplicate_rows"] == 2
    assert result.counts["rows_with_missing_values"] == 1
    assert result.counts["final_row_count"] == 4
    cleaned = result.cleaned
    assert cleaned.filter(F.col("region").isNull() | F.col("amount").isNull()).count() == 0


def test_duplicates_after_trimming(frame, rows_of):
    result = g.clean(frame([(1, "x"), (1, "x ")], "id int, v string"))
    reason = "Exact duplicate - matches 1 other row(s) (group 1)"
    assert rows_of(result.duplicates) == [(reason, 1, "x"), (reason, 1, "x ")]
    assert rows_of(result.cleaned) == [(1, "x")]
    assert result.counts["duplicate_rows_removed"] == 1


def test_groups_are_numbered_by_their_first_row(frame, rows_of):
    rows = [("z", None), ("b", 1), ("a", 1), ("b", 1), ("z", None), ("a", 1), ("b", 1), ("c", 1)]
    found = rows_of(g.clean(frame(rows, "v string, n int")).duplicates)
    assert [(r[0][-9:], r[1]) for r in found] == [
        ("(group 1)", "z"), ("(group 2)", "b"), ("(group 3)", "a"), ("(group 2)", "b"),
        ("(group 1)", "z"), ("(group 3)", "a"), ("(group 2)", "b"),
    ]
    assert found[1][0].startswith("Exact duplicate - matches 2 other")


def test_fills_can_make_rows_equal(frame, rows_of):
    rows = [(1, "Unknown?"), (2, "a"), (2, None), (2, "Unknown!"), (3, "b")]
    result = g.clean(frame([(9, "a"), (9, "a")] + rows, "k int, v string"))
    assert result.counts["duplicate_rows_removed"] == 1
    filled = frame([(2.0, 5), (None, 5), (2.0, 6)], "v double, n int")
    result = g.clean(filled)
    assert rows_of(result.duplicates) == []
    assert rows_of(result.cleaned) == [(2.0, 5), (2.0, 6)]


def test_nulls_equal_nulls_and_places_matter(frame):
    rows = [(None, "a"), (None, "a"), ("a", None), ("a", "a")]
    result = g.clean(frame(rows, "x string, y string"))
    assert result.duplicate_members == 2


def test_lone_conflict_lists_no_columns(frame, rows_of):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
    result = g.clean(frame(rows, "id int, v string"))
    assert rows_of(result.conflicts) == [("Same id as another row, but differs in: ", 1, "b")]


def test_conflicts_compare_nulls(frame, rows_of):
    rows = [(1, "a", None), (1, "a", 5), (None, "a", 1), (None, "b", 2)]
    result = g.clean(frame(rows, "id int, v string, n int"))
    assert [r[0] for r in rows_of(result.conflicts)] == ["Same id as another row, but differs in: n"] * 2


def test_empty_rows_do_not_make_conflicts(frame):
    rows = [(1, "a", 2), (1, None, None), (2, "b", 3)]
    assert g.clean(frame(rows, "id int, v string, n int")).counts["conflicting_duplicate_rows"] == 0


def test_a_row_is_empty_when_its_only_column_is(frame):
    result = g.clean(frame([("a",), (None,), ("?",)], "id string"))
    assert result.counts["empty_rows_removed"] == 2 and result.counts["final_row_count"] == 1


def test_column_without_values_is_left_null(frame, rows_of):
    result = g.clean(frame([(1, "?", None), (2, "-", None)], "n int, t string, d double"))
    assert rows_of(result.cleaned) == [(1, None, None), (2, None, None)]
    assert [c for c in result.changes if c[1] == "missing_values_filled"] == []


def test_median_of_whole_numbers_may_have_a_fraction(frame, rows_of):
    result = g.clean(frame([(1, "a"), (2, "b"), (None, "c")], "n int, v string"))
    assert rows_of(result.cleaned)[2] == (1.5, "c")


def test_median_ignores_empty_rows_and_keeps_duplicates(frame, rows_of):
    rows = [(1, 10.0), (1, 10.0), (2, 30.0), (3, None)]
    result = g.clean(frame([(*r, "x") for r in rows], "id int, v double, t string"))
    assert rows_of(result.cleaned)[-1] == (3, 10.0, "x")


def test_given_id_columns(frame):
    rows = [(1, "01/02/2024"), (1, "2024-01-03"), (2, "2024-01-04")]
    result = g.clean(frame(rows, "order_no int, day string"), id_columns=["order_no"])
    assert result.id_column == "order_no"
    assert result.counts["conflicting_duplicate_rows"] == 2


def test_table_without_rows(spark):
    result = g.clean(spark.createDataFrame([], "id int, v string"))
    assert result.counts["original_row_count"] == 0 and result.cleaned.count() == 0


def test_table_without_columns(spark):
    with pytest.raises(ValueError):
        g.clean(spark.range(1).select())


def mess(spark, copies=40):
    """Rows with hot duplicates, a hot ID and many spellings."""
    rows = []
    for i in range(60):
        rows.append((i % 25, f"Name {i % 7}" if i % 3 else f"NAME {i % 7}", None if i % 11 == 0 else float(i % 9)))
    rows += [(7, "hot row", 1.0)] * copies
    rows += [(3, f"hot id {i}", float(i)) for i in range(copies)]
    rows += [(None, "no id", 2.0)] * 12
    return [(*r, i) for i, r in enumerate(rows)], "id int, name string, v double, _row bigint"


def everything(df):
    result = g.clean(df)
    tables = (result.cleaned, result.duplicates, result.conflicts, result.missing, result.empty)
    return result.counts, [sorted((tuple(r) for r in t.collect()), key=repr) for t in tables], result.changes


def test_result_does_not_depend_on_partitions(spark):
    rows, schema = mess(spark)
    df = spark.createDataFrame(rows, schema)
    one, seven = everything(df.repartition(1)), everything(df.repartition(7))
    assert one == seven


def test_counts_add_up(spark):
    rows, schema = mess(spark)
    counts, tables, _ = everything(spark.createDataFrame(rows, schema))
    assert (
        counts["original_row_count"] - counts["empty_rows_removed"] - counts["duplicate_rows_removed"]
        == counts["final_row_count"]
        == len(tables[0])
    )
    assert counts["conflicting_duplicate_rows"] == len(tables[2])
    assert counts["rows_with_missing_values"] == len(tables[3])


def test_large_table_ways_give_the_same(spark, monkeypatch):
    """Salted joins and grouping instead of broadcasts."""
    from gristmill.operators import skew

    rows, schema = mess(spark)
    df = spark.createDataFrame(rows, schema)
    expected = everything(df)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    assert everything(df) == expected
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    assert everything(df) == expected


def test_columns_named_like_helpers(spark):
    """Every operation leaves columns alone that are named as helpers might be."""
    names = ["_id", "_key", "_before", "_k1", "_k2", "_n", "_at", "_salt", "_best", "_first", "_day", "_m0", "_group", "_name", "reason"]
    rows = [(1, *[f"{n} a" for n in names], 1.5), (1, *[f"{n} b" for n in names], 2.5), (2, *["x"] * len(names), None)]
    df = spark.createDataFrame(rows, "order_id int, " + ", ".join(f"`{n}` string" for n in names) + ", v double")
    result = g.clean(df)
    assert result.cleaned.columns == [*df.columns, "_row"]
    conflicts = result.conflicts.collect()
    assert [r["_reason"] for r in conflicts] == [f"Same order_id as another row, but differs in: {', '.join([*names, 'v'])}"] * 2
    assert sorted(r["_id"] for r in conflicts) == ["_id a", "_id b"]
    assert g.profile(df).columns.count() == len(df.columns)
    assert g.analyze(df).outliers.count() == 0
    other = df.select("order_id", "_key", "_salt")
    assert g.gather({"a": df, "b": other}).joined.count() >= 3
