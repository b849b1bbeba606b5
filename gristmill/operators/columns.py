"""Per-column statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import DUPLICATE_VALUE_EXAMPLES, NEAR_UNIQUE_SHARE, TOP_VALUES
from gristmill.functions import numbers, text
from gristmill.naming import IdNames, col
from gristmill.operators.cells import COLUMN, cells, spell_out, value_counts
from gristmill.operators.store import keep

STAT_DIGITS = 4
PERCENT_DIGITS = 2

# Columns per aggregate, to keep generated code small. Columnar files are read once all the same.
_COLUMNS_AT_ONCE = 50


def values_of(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    """Columns as text, with NaN as null."""
    types = dict(df.dtypes)
    return {n: text.as_text(numbers.no_nan(col(n), types[n]), types[n], ".0") for n in names}


def number_stats(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """Null count of every column, and mean, min, max where the column is a number or a flag."""
    found = {}
    for start in range(0, len(names), _COLUMNS_AT_ONCE):
        found.update(_number_stats(df, names[start : start + _COLUMNS_AT_ONCE]))
    return found


def _number_stats(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    types = dict(df.dtypes)
    stats = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        stats.append(F.count(numbers.no_nan(col(n), types[n])).alias(f"c{i}"))
        number = as_double(df, n)
        if number is not None:
            stats += [F.avg(number).alias(f"a{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}")]
    row = df.agg(*stats).first().asDict()
    return {
        n: {
            "rows": row["rows"],
            "filled": row[f"c{i}"],
            **({"mean": row[f"a{i}"], "min": row[f"l{i}"], "max": row[f"h{i}"]} if f"a{i}" in row else {}),
        }
        for i, n in enumerate(names)
    }


def as_double(df: DataFrame, name: str) -> Column | None:
    """A number or flag column as double, None for others."""
    kind = dict(df.dtypes)[name]
    if kind == "boolean":
        return col(name).cast("int").cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return numbers.no_nan(col(name), kind).cast("double")
    return None


class ColumnValues:
    """Distinct values of columns with their counts, kept once and asked several times."""

    def __init__(self, df: DataFrame, names: Sequence[str], folded: bool = True):
        self.df = df
        self.names = list(names)
        self.counts = keep(value_counts(df, self.names, fold=folded))

    def _rows(self, df: DataFrame) -> dict[str, dict]:
        return {self.names[r[COLUMN]]: r.asDict() for r in df.collect()}

    def facts(self) -> dict[str, dict]:
        """Per column: distinct values, filled cells, and copies beyond the first of each value."""
        return self._rows(
            self.counts.groupBy(COLUMN).agg(
                F.count(F.lit(1)).alias("unique"),
                F.sum("n").alias("filled"),
                F.sum(F.col("n") - 1).alias("extra"),
            )
        )

    def named(self) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in self.names]), F.col(COLUMN) + 1)

    def _whole(self, picked: DataFrame) -> DataFrame:
        """Picked keys with their texts."""
        texts = spell_out(self.df, self.names, picked)
        if texts is None:
            return picked.withColumn("value", F.col("key"))
        return picked.join(texts, [COLUMN, "key"])

    def most_frequent(self, names: Iterable[str], top: int = TOP_VALUES, repeated_only: bool = False) -> DataFrame:
        """(column, rank, value, n): the most frequent values, first seen first on a tie.

        Spark cuts every task to ``top`` values per column before the shuffle.
        """
        numbers_ = [self.names.index(n) for n in names]
        picked = self.counts.filter(F.col(COLUMN).isin(numbers_) if numbers_ else F.lit(False))
        if repeated_only:
            picked = picked.filter("n > 1")
        order = Window.partitionBy(COLUMN).orderBy(F.desc("n"), "first_row")
        picked = picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        picked = keep(picked.select(COLUMN, "key", "rank", "n"))
        return self._whole(picked).select(
            self.named().alias("column"), F.col("rank").cast("bigint").alias("rank"), "value", "n"
        )

    def casing_examples(self, names: Iterable[str]) -> DataFrame:
        """(column, spelling): the spellings of the first text written in several ways."""
        numbers_ = [self.names.index(n) for n in names]
        counts = self.counts.filter(F.col(COLUMN).isin(numbers_) if numbers_ else F.lit(False))
        several = (
            counts.groupBy(COLUMN, "folded")
            .agg(F.count(F.lit(1)).alias("spellings"), F.min("first_row").alias("seen"))
            .filter("spellings > 1")
        )
        order = Window.partitionBy(COLUMN).orderBy("seen", "folded")
        first = several.withColumn("at", F.row_number().over(order)).filter("at = 1").select(COLUMN, "folded")
        picked = keep(counts.join(F.broadcast(first), [COLUMN, "folded"]).select(COLUMN, "key"))
        return self._whole(picked).select(self.named().alias("column"), F.col("value").alias("spelling"))


def should_be_unique(name: str, ids: IdNames, unique: int, filled: int) -> bool:
    return filled > 0 and (name in ids or unique / filled >= NEAR_UNIQUE_SHARE)


def repeated_values(values: ColumnValues, facts: Mapping[str, dict], ids: IdNames) -> tuple[dict[str, int], DataFrame]:
    """Columns that look unique and are not: extra copies per column, and the worst values."""
    found = {
        n: f["extra"] for n, f in facts.items() if f["extra"] and should_be_unique(n, ids, f["unique"], f["filled"])
    }
    return found, values.most_frequent(found, DUPLICATE_VALUE_EXAMPLES, repeated_only=True)


def blank_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, blank_like): cells of text columns holding a missing-value marker, nulls not counted."""
    long = cells(df, [[text.strip(col(n))] for n in names], ["value"])
    counted = long.groupBy(COLUMN).agg(F.count_if(text.is_blank(F.col("value"))).alias("blank_like"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(COLUMN) + 1)
    return counted.select(named.alias("column"), "blank_like")
