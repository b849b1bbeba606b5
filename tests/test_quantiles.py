import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def narrowed(df, columns, probs=PROBS, **options):
    return exact_quantiles(df, {c: F.col(c) for c in columns}, probs, small_rows=10, **options)


def test_narrowing_equals_sorting(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.lognormal(3, 2, 4000), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    assert narrowed(df, ["v"])["v"] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_one_value_holds_most_rows(spark):
    values = [5.0] * 3000 + [float(i) for i in range(500)] + [-1.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert narrowed(df, ["v"])["v"] == pytest.approx(list(np.quantile(values, PROBS)))


def test_several_columns_with_gaps(spark):
    df = spark.range(2000).select(
        F.col("id").alias("a"),
        F.when(F.col("id") % 3 == 0, F.col("id") * 0.5).alias("b"),
        F.lit(None).cast("double").alias("none"),
        F.lit(7).alias("same"),
    )
    found = narrowed(df, ["a", "b", "none", "same"])
    assert found["a"] == pytest.approx(list(np.quantile(np.arange(2000), PROBS)))
    assert found["b"] == pytest.approx(list(np.quantile(np.arange(0, 2000, 3) * 0.5, PROBS)))
    assert found["none"] is None
    assert found["same"] == [7.0] * 5


def test_small_tables_take_the_short_way(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "v int")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.75]) == {"v": [1.75, 2.5, 4.75]}
    assert exact_quantiles(df, {}, [0.5]) == {}


def test_both_ways_agree_to_the_last_digit(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(20, 9, 1_004).round(3)], "v double").repartition(3)
    probabilities = [i / 100 for i in range(100)]
    small = exact_quantiles(df, {"v": F.col("v")}, probabilities, small_rows=10_000)["v"]
    assert narrowed(df, ["v"], probabilities)["v"] == small


def test_ranks_outside_their_bounds_are_found_all_the_same(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=30_000)
    df = spark.createDataFrame([(float(v), float(v) // 1) for v in values], "v double, w double").repartition(3)
    exact = {c: exact_quantiles(df, {c: F.col(c)}, PROBS)[c] for c in ("v", "w")}
    assert narrowed(df, ["v", "w"], margin=0.0) == exact  # bounds without any room
    assert narrowed(df, ["v", "w"], margin=0.3) == exact


def test_two_reads_for_any_number_of_columns(spark, tmp_path):
    spark.range(5000, numPartitions=3).select(*[(F.rand(i) * 100).alias(f"c{i}") for i in range(12)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)
    counts = {f"c{i}": 5000 for i in range(12)}
    seen = df.mapInArrow(lambda batches: (reads.add(b.num_rows) or b for b in batches), df.schema)
    found = exact_quantiles(seen, {c: F.col(c) for c in counts}, [0.25, 0.5, 0.75], counts, small_rows=10, margin=0.05)
    assert reads.value == 2 * 5000
    assert found == exact_quantiles(df, {c: F.col(c) for c in counts}, [0.25, 0.5, 0.75], counts)
