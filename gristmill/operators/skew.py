"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.naming import col
from gristmill.operators.store import keep

# A key is hot from this many rows on, or from this share of all rows if that is more.
# The share bounds how many hot keys there can be, whatever the data: 1 / HOT_SHARE.
HOT_ROWS = 200_000
HOT_SHARE = 1e-5

# Rows with a null key match nothing; they are dealt out to so many salts.
NULL_SALTS = 200

# A table is broadcast only after its size was measured to be within this.
BROADCAST_BYTES = 32 * 1024 * 1024


def byte_size(table: DataFrame) -> Column:
    """An aggregate: the bytes a table's rows hold."""
    size = F.lit(0)
    for name, kind in table.dtypes:
        size = size + (F.coalesce(F.octet_length(col(name)), F.lit(0)) if kind == "string" else F.lit(8))
    return F.coalesce(F.sum(size.cast("bigint")), F.lit(0))


def fits(size: int) -> bool:
    return size <= BROADCAST_BYTES


def is_small(table: DataFrame) -> bool:
    """Measure a written table: may it be broadcast?"""
    return fits(table.agg(byte_size(table)).first()[0])


def hot_keys(counts: DataFrame, keys: Sequence[str], total: int, n: str = "n") -> DataFrame | None:
    """From counted keys, the few hot ones with the number of salts each needs."""
    limit = max(HOT_ROWS, total * HOT_SHARE)
    salts = F.ceil(F.col(n) / F.lit(limit)).cast("int")
    hot = keep(counts.filter(F.col(n) >= limit).select(*[col(k) for k in keys], salts.alias("_gm_salts")))
    return None if hot.isEmpty() else hot


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    how: str = "inner",
    small: bool = False,
) -> DataFrame:
    """Join rows to a table that has each key once. Null keys match nothing.

    A table measured as small is broadcast. Otherwise the rows of a hot key are spread over
    several salts, and the table's row for that key is repeated once per salt, so no task
    receives the whole key. Null keys are spread, too, in a left join. The salt is a hash of the
    whole row, the same whenever a task is run again.
    """
    keys = list(keys)
    if small:
        return rows.join(F.broadcast(table), keys, how)
    if hot is None and how == "inner":
        return rows.join(table, keys, how)
    content = F.xxhash64(*[col(c) for c in rows.columns])
    no_key = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
    if hot is None:
        null_salt = F.when(no_key, F.pmod(content, F.lit(NULL_SALTS))).otherwise(F.lit(0)).cast("int")
        salted_rows = rows.withColumn("_gm_salt", null_salt)
        return salted_rows.join(table.withColumn("_gm_salt", F.lit(0)), [*keys, "_gm_salt"], how).drop("_gm_salt")
    hot = F.broadcast(hot)
    salts = F.when(no_key, F.lit(NULL_SALTS)).otherwise(F.coalesce(F.col("_gm_salts"), F.lit(1)))
    salt = F.pmod(content, salts)
    every_salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_gm_salts"), F.lit(1)) - 1))
    salted_rows = rows.join(hot, keys, "left").withColumn("_gm_salt", salt.cast("int")).drop("_gm_salts")
    salted_table = table.join(hot, keys, "left").withColumn("_gm_salt", every_salt).drop("_gm_salts")
    return salted_rows.join(salted_table, [*keys, "_gm_salt"], how).drop("_gm_salt")
