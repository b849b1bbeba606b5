"""Row order. Order decides ties and examples only; nothing is ever joined on it."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.naming import ROW, col
from gristmill.operators.skew import is_small
from gristmill.operators.store import keep

# monotonically_increasing_id() puts the partition above bit 33 and the position below.
POSITION_BITS = 33
# Rows of one file have places below 2 to this power; the file's number is above.
PLACE_BITS = 40
# The numbers of so many files are a literal of the plan; those of more are a table to join.
RANKED_FILES = 4_096


def with_row_order(df: DataFrame, order: str | Column | None = None) -> DataFrame:
    """Add the row order key: a whole-number expression, or the order of the scan."""
    if order is None:
        order = F.monotonically_increasing_id()
    elif isinstance(order, str):
        order = F.expr(order)
    return df.withColumn(ROW, order.cast("bigint"))


def _bare_path() -> Column:
    """The path of a row's file without its scheme, which is spelled in several ways."""
    return F.ltrim(F.substring_index("_metadata.file_path", ":/", -1), F.lit("/"))


def _file_ranks(paths: Sequence[str]) -> Column | None:
    """The place of a row's file in the order of paths, as an expression; None for many files.

    The paths are in a hash table that is a literal of the plan: a checksum names a short list, in which it is found.
    """
    sums = [zlib.crc32(p.encode()) for p in paths]
    if len(paths) > RANKED_FILES or len(set(sums)) < len(sums):
        return None
    lists: list[dict] = [{"c": [], "r": []} for _ in sums]
    for rank, c in enumerate(sums):
        lists[c % len(sums)]["c"].append(c)
        lists[c % len(sums)]["r"].append(rank)
    table = F.from_json(F.lit(json.dumps(lists)), "array<struct<c: array<bigint>, r: array<bigint>>>")
    own = F.crc32(_bare_path().cast("binary"))
    found = F.get(table, (own % len(sums)).cast("int"))
    return F.get(found["r"], (F.array_position(found["c"], own) - 1).cast("int"))


def with_file_order(files: DataFrame, row_index: bool = False) -> DataFrame:
    """Rows just read from files, in the order of the files' paths and of the places in them.

    Spark packs files into partitions by size, so the order of the scan is not that of the files. With ``row_index``
    (Parquet) the reader knows a row's place, and the plan is the scan alone. Other rows are numbered within their file
    split, and the splits' sizes, counted once and few against the rows, are added up in order.
    """
    paths = files.inputFiles()
    if len(paths) < 2:
        return with_row_order(files)
    columns = [col(c) for c in files.columns]
    path, start = F.col("_metadata.file_path").alias("_gm_path"), F.col("_metadata.file_block_start").alias("_gm_start")
    if row_index:
        paths = [p.rsplit(":/", 1)[-1].lstrip("/") for p in sorted(paths)]
        place = F.col("_metadata.row_index")
        rank = _file_ranks(paths)
        if rank is not None:
            return files.select(*columns, (F.shiftleft(rank, PLACE_BITS) + place).alias(ROW))
        ordered = [(p, n) for n, p in enumerate(paths)]
        ranks = _small(keep(files.sparkSession.createDataFrame(ordered, "_gm_path string, _gm_rank bigint")))
        joined = files.select(*columns, _bare_path().alias("_gm_path"), place.alias("_gm_place")).join(ranks, "_gm_path")
        return joined.select(*columns, (F.shiftleft("_gm_rank", PLACE_BITS) + F.col("_gm_place")).alias(ROW))
    placed = files.select(*columns, path, start, F.monotonically_increasing_id().alias("_gm_at"))
    splits = placed.groupBy("_gm_path", "_gm_start").agg(F.count(F.lit(1)).alias("_gm_n"), F.min("_gm_at").alias("_gm_first"))
    before = Window.orderBy("_gm_path", "_gm_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_gm_before", F.coalesce(F.sum("_gm_n").over(before), F.lit(0))).drop("_gm_n")
    joined = placed.join(_small(keep(offsets)), ["_gm_path", "_gm_start"])
    order = F.col("_gm_before") + F.col("_gm_at") - F.col("_gm_first")
    return joined.select(*columns, order.alias(ROW))


def _small(table: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it was measured as small."""
    return F.broadcast(table) if is_small(table) else table


def ensure_row_order(df: DataFrame) -> DataFrame:
    return df if ROW in df.columns else with_row_order(df)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows 1, 2, 3, ... in a given order, without a single-partition window.

    Range-partitioned and sorted rows are written with their position inside the
    partition; the only thing the driver sees is one row count per partition.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("_gm_at", F.monotonically_increasing_id()))
    part = F.shiftright("_gm_at", POSITION_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("_gm_part")).count().collect())
    offsets, total = [], 0
    for number, size in sizes:
        offsets.append((number, total))
        total += size
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("bigint")).drop("_gm_at")
    table = spark.createDataFrame(offsets, f"_gm_part bigint, _gm_before bigint")
    position = F.col("_gm_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        placed.withColumn("_gm_part", part.cast("bigint"))
        .join(F.broadcast(table), "_gm_part")
        .withColumn(name, F.col("_gm_before") + position + 1)
        .drop("_gm_part", "_gm_at", "_gm_before")
    )
