import re

import pytest

import gristmill as g
from gristmill.operators import order
from gristmill.sources.tables import read_parquet


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def three_files(spark, tmp_path):
    for i, name in enumerate(["b 1%.parquet", "a é.parquet", "c.parquet"]):
        spark.range(10 * i, 10 * i + 5, numPartitions=2).write.parquet(f"{tmp_path}/{name}")
    return f"{tmp_path}/*.parquet"


WANTED = [*range(10, 15), *range(5), *range(20, 25)]


def test_parquet_rows_are_ordered_by_one_scan(spark, three_files):
    df = read_parquet(spark, three_files)
    plan = plan_of(df)
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    assert [r["id"] for r in df.orderBy("_row").collect()] == WANTED
    assert df.select("_row").distinct().count() == len(WANTED)


def test_many_files_are_ordered_by_a_table(spark, three_files, monkeypatch):
    monkeypatch.setattr(order, "RANKED_FILES", 2)
    df = read_parquet(spark, three_files)
    assert "Join" in plan_of(df)
    assert [r["id"] for r in df.orderBy("_row").collect()] == WANTED


def test_text_rows_are_ordered_over_files(spark, tmp_path):
    for i, name in enumerate(["b.csv", "a.csv"]):
        (tmp_path / name).write_text("x\n" + "".join(f"{100 * i + k}\n" for k in range(50)))
    df = g.read_csv(spark, f"{tmp_path}/*.csv").df
    assert [r["x"] for r in df.orderBy("_row").collect()] == [*range(100, 150), *range(50)]


def joined(spark):
    """Two tables; key 3 is frequent in the first, key 5 in the second, some keys are null."""
    a = [(None if k % 17 == 0 else 3 if k % 2 else k % 40, k) for k in range(400)]
    b = [(None if k == 9 else 5 if k % 3 else k, -k) for k in range(90)]
    return g.gather({"a": spark.createDataFrame(a, "key int, x int"), "b": spark.createDataFrame(b, "key int, y int")}, min_overlap=0.1)


def files_in_order(spark, path):
    rows = [r for r in spark.read.parquet(path).selectExpr("*", "_metadata.file_name AS file", "_metadata.row_index AS at").collect()]
    part = lambda r: int(re.match(r"part-(\d+)", r["file"])[1])
    return sorted(rows, key=lambda r: (part(r), r["at"])), {part(r) for r in rows}


@pytest.mark.parametrize("hot", [False, True])
def test_joined_files_follow_each_other_in_key_order(spark, tmp_path, hot, request):
    if hot:
        request.getfixturevalue("tiny_limits")
    result = joined(spark)
    path = g.write_gather(result, str(tmp_path), ordered=True)["gathered"]
    rows, files = files_in_order(spark, path)
    assert len(files) > 2
    keys = [r["key"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    plain = [(r["key"], r["x"], r["y"]) for r in result.joined.collect()]
    assert sorted(((r["key"], r["x"], r["y"]) for r in rows), key=repr) == sorted(plain, key=repr)
    null_rows = sum(k is None for k in keys)
    assert result.summary.first()["null_key_rows"] == null_rows > 10
    threes = {r["file"] for r in rows if r["key"] == 3}
    if hot:
        assert len(threes) > 1  # a hot key lies in several files
    else:
        assert [r["x"] for r in rows if r["key"] == 3] == [k for k in range(400) if k % 2 and k % 17]  # in the order of its rows


def test_ordered_tables_kept_apart_and_empty(spark, tmp_path):
    a = spark.createDataFrame([(1,)], "p int")
    apart = g.gather({"a.csv": a, "b.csv": a.withColumnRenamed("p", "q")})
    assert sorted(g.write_gather(apart, str(tmp_path), ordered=True)) == ["a", "b"]
    assert apart.summary.first()["null_key_rows"] is None
    empty = g.gather({"a": a.limit(0), "b": a.limit(0)}, min_overlap=0.0)
    assert empty.joined_in_order is None or empty.joined_in_order.count() == 0
