"""Rows of a join are dealt out evenly, null keys and hot keys included."""

from pyspark.sql import functions as F

from gristmill.operators.skew import lookup


def partition_sizes(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return sizes


def test_null_and_hot_keys_are_dealt_out(spark):
    key = F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)))
    rows = spark.range(40_000).select(key.alias("k"), F.col("id").alias("_row"))
    table = spark.range(97).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1)], "k string, v long")
    )
    hot = spark.createDataFrame([("hot", 50)], "k string, _gm_salts int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for given in (hot, None):
            joined = lookup(rows, table, ["k"], given, "left")
            assert joined.count() == 40_000
            assert joined.filter("k is null and v is not null").count() == 0
            assert joined.filter("k is not null and v is null").count() == 0
        sizes = partition_sizes(spark, lookup(rows, table, ["k"], hot, "left"))
        assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
