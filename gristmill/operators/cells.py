"""Cells of many columns as one long table, and counts of their distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import no_nan
from gristmill.functions.text import as_text, compact, is_digest
from gristmill.naming import ROW, col
from gristmill.operators.skew import is_small
from gristmill.operators.store import keep

COLUMN = "_gm_col"

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def cells(
    df: DataFrame,
    rows: Sequence[Sequence[Column]],
    names: Sequence[str],
    carried: Sequence[str] = (),
    numbers: Sequence[int] | None = None,
) -> DataFrame:
    """One output row per input row and column: its column number and the given values."""
    flat = [F.lit(len(rows))]
    for number, values in zip(range(len(rows)) if numbers is None else numbers, rows):
        flat += [F.lit(number), *values]
    return df.select(*carried, F.stack(*flat).alias(COLUMN, *names))


def settled(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Add costly columns as the output of a generator.

    The optimizer pushes no filter below a generator that makes the filtered column. As plain
    expressions they would be copied into the filter, once per mention and nested column.
    """
    return df.select(*[col(c) for c in df.columns if c not in values], F.stack(F.lit(1), *values.values()).alias(*values))


def value_counts(df: DataFrame, names: Sequence[str], fold: bool = False) -> DataFrame:
    """How often each distinct value of each column occurs, and in which row first.

    Columns of one type are counted together, under the values themselves; only distinct
    values are turned into text. Long texts are counted under their digest, so a shuffle row
    stays small whatever the texts' length. Counts combine on the map side first: a value
    that fills a third of the table leaves each task as one row. ``folded`` is the key of the
    lower-cased text where ``fold`` asks for it, else the key.
    """
    kinds = dict(df.dtypes)
    families: dict[str, list[int]] = {}
    for number, name in enumerate(names):
        kind = "bigint" if kinds[name] in _WHOLE else kinds[name]
        families.setdefault(kind, []).append(number)
    counted = [_count_family(df, names, numbers, kind, fold) for kind, numbers in families.items()]
    return reduce(DataFrame.unionByName, counted)


def _count_family(df: DataFrame, names: Sequence[str], numbers: list[int], kind: str, fold: bool) -> DataFrame:
    value = F.col("value")
    rows = [[no_nan(col(names[i]), kind).cast(kind)] for i in numbers]
    long = cells(df, rows, ["value"], carried=[ROW], numbers=numbers).filter(value.isNotNull())
    if kind == "string":
        keys = {"key": compact(value)}
        if fold:
            # Only where it differs from the key, to keep shuffle rows short.
            keys["folded"] = F.when(F.lower(value) != value, compact(F.lower(value)))
    else:
        keys = {"key": value}
    grouped = long.select(COLUMN, ROW, *[k.alias(n) for n, k in keys.items()]).groupBy(COLUMN, *keys)
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"))
    key = F.col("key") if kind == "string" else as_text(F.col("key"), kind, ".0")
    folded = F.coalesce("folded", key) if "folded" in keys else key
    return counted.select(COLUMN, key.alias("key"), folded.alias("folded"), "n", "first_row")


def spell_out(df: DataFrame, names: Sequence[str], picked: DataFrame) -> DataFrame | None:
    """The whole texts (column, key, value) of picked keys; None if every key is its own text."""
    digests = keep(picked.filter(is_digest(F.col("key"))).select(COLUMN, "key").distinct())
    wanted = sorted(r[0] for r in digests.select(COLUMN).distinct().collect())
    if not wanted:
        return None
    texts = cells(df, [[col(names[i])] for i in wanted], ["value"], numbers=wanted)
    texts = texts.withColumn("key", compact(F.col("value"))).filter(is_digest(F.col("key")))
    if is_small(digests):
        found = _distinct(texts.join(F.broadcast(digests), [COLUMN, "key"]))
    else:
        # Copies are merged before the join, so that no frequent text fills a task.
        found = _distinct(texts).join(digests, [COLUMN, "key"])
    short = picked.filter(~is_digest(F.col("key"))).select(COLUMN, "key", F.col("key").alias("value"))
    return found.unionByName(short.distinct())


def _distinct(texts: DataFrame) -> DataFrame:
    """Each (column, key, value) once, merged on the map side by hash."""
    return texts.groupBy(COLUMN, "key", "value").agg(F.count(F.lit(1))).select(COLUMN, "key", "value")
