import gristmill as g

LONG = "word " * 5000


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_columns(frame):
    rows = [
        (1, "North", 10.0, True), (2, "north", 20.0, False), (2, " N/A ", None, None), (4, None, 40.0, True),
        (5, "South", float("nan"), True),
    ]
    found = by_column(g.profile(frame(rows, "order_id int, region string, amount double, paid boolean")).columns)
    assert found["order_id"]["duplicate_value_count"] == 1
    assert found["region"]["blank_like_count"] == 1 and found["region"]["null_count"] == 1
    assert found["region"]["unique_count"] == 4 and found["region"]["mean"] is None
    assert found["amount"]["null_count"] == 2 and found["amount"]["null_percent"] == 40.0
    assert (found["amount"]["mean"], found["amount"]["median"]) == (23.3333, 20.0)
    assert (found["amount"]["min"], found["amount"]["max"]) == (10.0, 40.0)
    assert found["paid"]["mean"] == 0.75 and found["paid"]["dtype"] == "boolean"


def test_column_without_values(frame):
    found = by_column(g.profile(frame([(None, 1), (None, 2)], "v string, n int")).columns)
    assert found["v"]["all_values_null"] and found["v"]["unique_count"] == 0
    assert not found["n"]["all_values_null"]


def test_near_unique_columns_are_checked_and_others_not(frame):
    values = [f"v{i}" for i in range(19)] + ["v0"]
    found = by_column(g.profile(frame([(v, "same") for v in values], "code string, kind string")).columns)
    assert found["code"]["duplicate_value_count"] == 1
    assert found["kind"]["duplicate_value_count"] is None


def test_top_values_first_seen_first_on_a_tie(frame):
    found = g.profile(frame(["b", "a", "b", "a", "c", "z", "y", "x"], "v string")).top_values.orderBy("rank")
    assert [(r["value"], r["n"]) for r in found.collect()] == [("b", 2), ("a", 2), ("c", 1), ("z", 1), ("y", 1)]


def test_long_texts_come_back_whole(frame):
    result = g.profile(frame([LONG, LONG.upper(), LONG, "x"], "v string"))
    assert result.top_values.filter("rank = 1").first()["value"] == LONG
    assert {r["spelling"] for r in result.casing_examples.collect()} == {LONG, LONG.upper()}


def test_casing_example_is_the_first_text_with_several_spellings(frame):
    values = ["solo", "North", "b", "north", "B", "NORTH"]
    found = g.profile(frame(values, "v string")).casing_examples
    assert sorted(r["spelling"] for r in found.collect()) == ["NORTH", "North", "north"]


def test_padded_markers_of_any_length_are_blank_like(frame):
    found = by_column(g.profile(frame([" " * 80, " " * 60 + "N/A", "x"], "v string")).columns)
    assert found["v"]["blank_like_count"] == 2


def test_repeated_rows(frame, rows_of):
    rows = [("x", 1), ("a", None), ("b", 2), ("a", None), ("b", 2), ("b", 2)]
    result = g.profile(frame(rows, "v string, n int"))
    assert {r["metric"]: r["value"] for r in result.table.collect()} == {
        "row_count": 6, "column_count": 2, "duplicate_row_count": 3,
    }
    assert rows_of(result.duplicate_row_examples) == [("a", None), ("b", 2), ("a", None)]


def test_large_table_ways_give_the_same(frame, rows_of, tiny_limits):
    rows = [("hot", 1)] * 40 + [(f"v{i % 9}", i % 3) for i in range(60)]
    result = g.profile(frame(rows, "v string, n int"))
    assert {r["metric"]: r["value"] for r in result.table.collect()}["duplicate_row_count"] == 39 + 51
    assert rows_of(result.duplicate_row_examples) == [("hot", 1)] * 3


def test_table_without_rows(spark):
    result = g.profile(spark.createDataFrame([], "a int, b string"))
    assert result.warning and result.row_count == 0 and result.columns.count() == 0


def test_wide_tables(spark):
    from pyspark.sql import functions as F

    columns = [(F.col("id") * k).alias(f"n{k}") for k in range(70)] + [F.concat(F.lit(f"t{k}"), "id").alias(f"t{k}") for k in range(40)]
    df = spark.range(30).select(*columns)
    found = by_column(g.profile(df).columns)
    assert len(found) == 110
    assert found["n69"]["median"] == 14.5 * 69 and found["n69"]["max"] == 29 * 69
    assert found["t39"]["unique_count"] == 30
    assert g.clean(df).counts["final_row_count"] == 30
