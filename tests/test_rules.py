"""Each column rule: the values it gives and the cells it counts."""

import pytest

import gristmill as g
from gristmill.functions.text import WHITESPACE


def cleaned_column(frame, rows_of, values, name="c"):
    result = g.clean(frame(values, f"`{name}` string"))
    counts = {metric: n for _, metric, n in result.changes}
    return [r[0] for r in rows_of(result.repaired)], counts


@pytest.fixture
def rule(frame, rows_of):
    return lambda values, name="c": cleaned_column(frame, rows_of, values, name)


def test_outer_blanks_go_and_are_counted(rule):
    out, counts = rule(["oak  ", "\telm", "ash", None, "fir tree "])
    assert out == ["oak", "elm", "ash", None, "fir tree"]
    assert counts["whitespace_trimmed"] == 3


def test_every_kind_of_whitespace_is_trimmed(rule):
    out, counts = rule([f"{WHITESPACE}a{WHITESPACE}", " b c "])
    assert out == ["a", "b c"]
    assert counts["whitespace_trimmed"] == 2


def test_padded_markers_are_nulls_not_trims(rule):
    out, counts = rule(["birch", " Missing", "nil ", "unknown", "n.a.", "birch"])
    assert out == ["birch", None, None, None, None, "birch"]
    assert counts["blank_like_converted_to_null"] == 4
    assert "whitespace_trimmed" not in counts


def test_every_marker_in_any_case(rule):
    from gristmill.constants import BLANK_MARKERS

    values = [f" {m.upper()}" for m in BLANK_MARKERS] + ["beech"]
    out, counts = rule(values)
    assert out == [None] * len(BLANK_MARKERS) + ["beech"]
    assert counts["blank_like_converted_to_null"] == len(BLANK_MARKERS)


def test_the_spelling_of_most_cells_replaces_the_others(rule):
    out, counts = rule(["maple", "Maple", "MAPLE", "Maple", "larch", "mAple"])
    assert out == ["Maple"] * 4 + ["larch", "Maple"]
    assert counts["casing_standardized"] == 3


def test_on_a_tie_the_earlier_spelling_stays(rule):
    out, _ = rule(["Red Oak", "pine", "red oak"])
    assert out == ["Red Oak", "pine", "Red Oak"]


def test_casing_of_long_texts(rule):
    long = "An Ode to " + "very " * 2000 + "long texts"
    out, counts = rule([long, long.upper(), long.upper(), "x"])
    assert out == [long.upper()] * 3 + ["x"]
    assert counts["casing_standardized"] == 1


def test_casing_of_frequent_long_texts_in_large_tables(rule, tiny_limits):
    a, b = "Ode to " + "very " * 50 + "long texts", "Other " + "very " * 50 + "long texts"
    values = [a] * 30 + [a.upper()] * 12 + [b.upper()] + [b] + ["x", "X", "X"] + ["y"] * 20
    out, counts = rule(values)
    assert out == [a] * 42 + [b.upper()] * 2 + ["X"] * 3 + ["y"] * 20
    assert counts["casing_standardized"] == 14


def test_casing_applies_to_id_columns(rule):
    out, _ = rule(["ab1", "AB1", "AB1"], "item_id")
    assert out == ["AB1"] * 3


@pytest.mark.parametrize(
    "values, expected, changed",
    [
        (["FEMALE", None, "m", "Male"], ["Female", None, "Male", "Male"], 2),
        (["N", "yes", "No", "Y", "Y"], ["No", "Yes", "No", "Yes", "Yes"], 4),
        (["False", "T", "true"], ["False", "True", "True"], 2),
        (["F", "f", "F"], ["Female"] * 3, 3),
        (["teak", "balsa"], ["teak", "balsa"], None),
        (["no", "male"], ["no", "male"], None),
    ],
)
def test_two_way_values(rule, values, expected, changed):
    out, counts = rule(values)
    assert out == expected
    assert counts.get("categories_standardized") == changed


def test_dates_of_several_shapes_become_iso(rule):
    out, counts = rule([None, "7 Mar 2021", "12/31/2020", "2021-02-03", "2021/4/5"], "felled_on")
    assert out == [None, "2021-03-07", "2020-12-31", "2021-02-03", "2021-04-05"]
    assert counts["dates_standardized"] == 3


def test_date_cells_that_do_not_parse_stay(rule):
    values = [f"2024-01-{d:02d}" for d in range(1, 20)] + ["2024-02-30"]
    out, _ = rule(["13/06/2024", *values], "day")
    assert out[0] == "2024-06-13" and out[-1] == "2024-02-30"


def test_too_few_dates_leave_the_column_alone(rule):
    values = ["03/04/2019", "03/05/2019", "2019-02-30"]
    assert rule(values, "day")[0] == values


def test_dates_in_id_columns_stay(rule):
    out, counts = rule(["2018-07-09", "07/10/2018"], "lot_id")
    assert out[1] == "07/10/2018" and not counts


def test_texts_of_numbers_become_numbers(rule):
    out, counts = rule([None, "0.25 ", "-8", "1e2"])
    assert out == [None, 0.25, -8.0, 100.0]
    assert counts["converted_to_numeric"] == 3


def test_whole_numbers_stay_whole_with_and_without_gaps(frame, rows_of):
    assert dict(g.clean(frame(["4", "9"], "c string")).repaired.dtypes)["c"] == "bigint"
    result = g.clean(frame([("9007199254740993", 1), ("9007199254740992", 2), ("?", 3)], "c string, n int"))
    assert rows_of(result.repaired) == [(9007199254740993, 1), (9007199254740992, 2), (None, 3)]
    assert [int(r[0]) for r in rows_of(result.cleaned)][:2] == [9007199254740993, 9007199254740992]
    assert len(rows_of(result.cleaned)) == 3


def test_a_decimal_median_keeps_its_fraction(frame, rows_of):
    from decimal import Decimal

    result = g.clean(frame([(Decimal(1), 1), (Decimal(2), 2), (None, 3)], "c decimal(10,0), n int"))
    assert [r[0] for r in rows_of(result.cleaned)] == [Decimal("1.0"), Decimal("2.0"), Decimal("1.5")]


@pytest.mark.parametrize("values", [["0040", "7311", None], ["6", "six"], ["3_000", "4"], ["5f", "6"]])
def test_codes_and_words_stay_text(rule, values):
    out, counts = rule(values)
    assert out == values and "converted_to_numeric" not in counts


def test_numbers_in_id_columns_stay_text(rule):
    assert rule(["1", "2"], "order_id")[0] == ["1", "2"]


def test_numeric_columns_skip_text_rules_and_nan_is_missing(frame, rows_of):
    result = g.clean(frame([(1.0, 1), (float("nan"), 2)], "v double, w int"))
    assert rows_of(result.repaired) == [(1.0, 1), (None, 2)]
    assert rows_of(result.cleaned) == [(1.0, 1), (1.0, 2)]


def test_flags_with_gaps_become_text(frame, rows_of):
    result = g.clean(frame([(True, 1), (None, 2), (False, 3)], "v boolean, n int"))
    assert rows_of(result.cleaned) == [("True", 1), ("Unknown", 2), ("False", 3)]
    whole = g.clean(frame([(True, 1), (False, 2)], "v boolean, n int"))
    assert rows_of(whole.cleaned) == [(True, 1), (False, 2)]


def test_timestamps_become_text_unless_kept(spark, frame, rows_of):
    df = frame([("2024-01-05 10:30:00", 1), (None, 2)], "t string, n int").withColumn(
        "t", __import__("pyspark").sql.functions.col("t").cast("timestamp_ntz")
    )
    result = g.clean(df)
    assert rows_of(result.cleaned) == [("2024-01-05", 1), ("Unknown", 2)]
    assert [c for c in result.changes if c[1] == "dates_standardized"] == []
    kept = rows_of(g.clean(df, keep_timestamps=True).cleaned)
    assert kept[0][0].hour == 10 and kept[1][0] is None


def test_rules_change_nothing_the_second_time(frame, rows_of):
    rows = [("yew ", "3", "N", "02/09/2017"), ("YEW", "q", "yes", "2017-02-08"), ("--", " q", "y", "9 May 2017")]
    once = g.clean(frame(rows, "a string, b string, c string, d string")).repaired
    twice = g.clean(once)
    assert rows_of(twice.repaired) == rows_of(once)
    assert [c for c in twice.changes if c[1] != "missing_values_filled"] == []


def test_odd_column_names(frame, rows_of):
    result = g.clean(frame([(" a", "x"), ("a", None)], "`First Name` string, `a.1,(b)=;` string"))
    assert rows_of(result.cleaned) == [("a", "x"), ("a", "Unknown")]


def test_large_spellings_of_all_columns_come_back_in_one_join(spark, tiny_limits):
    long = "x" * 60
    rows = [("Abc" if k % 3 else "ABC", long + ("Y" if k % 5 else "y"), None if k % 7 == 0 else "plain", k // 2) for k in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, _row bigint")  # two rows share each place
    result = g.clean(df)
    assert sorted(result.rules.respelled_apart) == ["a", "b"]
    assert result.counts  # decided before the plan is looked at
    got = [(r["a"], r["b"], r["c"], r["_row"]) for r in result.repaired.collect()]
    wanted = [("Abc", long + "Y", c, row) for _, _, c, row in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_large_spellings_of_one_column_move_its_rows_once(spark, tiny_limits):
    long = "x" * 60
    rows = [(None if k % 11 == 0 else long + ("Y" if k % 5 else "y"), k // 2) for k in range(60)]
    result = g.clean(spark.createDataFrame(rows, "a string, _row bigint"))
    assert result.rules.respelled_apart == ["a"]
    got = [(r["a"], r["_row"]) for r in result.repaired.collect()]
    assert sorted(got, key=repr) == sorted([(a and long + "Y", row) for a, row in rows], key=repr)
    plan = result.repaired._jdf.queryExecution().toString()
    assert "_gm_best" in plan and "_gm_of" not in plan  # the texts are joined to the rows, not first gathered by row
