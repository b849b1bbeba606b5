"""Rendezvous hashing of record keys over weighted shards, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gristmill.llm.common import stable

#: Rows that are alike in all that counts are numbered in runs of so many.
COPIES_AT_ONCE = 1 << 16


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """Per shard (-ln(u) / weight, shard), u being a hash of key and shard above 0 and at most 1.

    The smallest entry names the record's shard. A shard of weight 0 gets nothing. A further shard
    only takes records, and a removed one only gives records away. Null keys form one key.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more, one at least above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11).cast("double") + 1) / float(1 << 53)
        return F.struct((-F.log(u) / weight if weight else F.lit(float("inf"))).alias("score"), F.lit(shard).alias("shard"))

    return F.array(*[score(s, w) for s, w in enumerate(weights)])


def shard(
    records: DataFrame,
    weights: Sequence[float] = (1.0,) * 40,
    new_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Deal records to shards by key and number the records of each shard without gaps.

    Returns doc_id, size (bytes of the text plus 16), text_crc32, law ("key"), shard, slot and
    grown_shard (the shard if there were one more of weight new_weight). A null text is empty; null
    keys are one key; rows that repeat a key, equal or not, share its shard and each get a slot of their own.
    Slots follow a hash of the row's content, so they do not depend on partitions or retries.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one weight at least is above 0")
    text = F.coalesce(records[text_col].cast("string"), F.lit(""))
    rows = records.select(
        records[id_col].alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    runs = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_AT_ONCE))).alias("run"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scored = runs.withColumn("scores", shard_scores(F.col("doc_id"), [*weights, new_weight]))
    placed = stable(
        scored.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.col("n") - F.col("run") * COPIES_AT_ONCE, F.lit(COPIES_AT_ONCE)).cast("long").alias("n"),
            F.array_min(F.slice("scores", 1, len(weights)))["shard"].alias("shard"),
            F.array_min("scores")["shard"].alias("grown_shard"),
            F.md5(F.concat_ws(":", name, F.col("size"), F.col("text_crc32"), F.col("run"))).alias("place"),
            F.col("doc_id").isNull().alias("no_id"),
        ).withColumn("bucket", F.substring("place", 1, 4))
    )
    # 65,536 buckets a shard: each is numbered on its own, after the rows of the buckets before it.
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("here"))
    before = F.sum("here").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("here")
    starts = totals.select("shard", "bucket", before.alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "no_id")
    numbered = placed.withColumn("earlier", F.sum("n").over(inside) - F.col("n")).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"),
        (F.col("start") + F.col("earlier")).alias("first"),
        "grown_shard",
    ).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("i")).alias("slot"), "grown_shard"
    )
