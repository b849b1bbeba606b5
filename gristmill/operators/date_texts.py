"""Dates written as text, parsed once for each distinct text and not once for each row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import dates
from gristmill.naming import col
from gristmill.operators import skew
from gristmill.operators.cells import COLUMN, cells, settled
from gristmill.operators.store import keep

# A distinct date text with what it means takes up about so many bytes.
_ENTRY_BYTES = 80


def date_facts(value: Column, filled: Column) -> dict[str, Column]:
    """Aggregates over cells: those that look like dates, about how many distinct ones, and the bytes of the others."""
    looks = dates.looks_like_date(value)
    return {
        "date_like": F.count_if(filled & looks),
        "date_kinds": F.approx_count_distinct(F.when(filled & looks, value)),
        "other_bytes": F.coalesce(F.sum(F.when(filled & ~looks, F.octet_length(value)).cast("bigint")), F.lit(0)),
    }


def is_worth_it(facts: dict) -> bool:
    """Is a column's dictionary surely small? Columns with as many texts as rows are parsed row by row."""
    return skew.fits(facts["date_kinds"] * _ENTRY_BYTES + facts["other_bytes"])


class DateTexts:
    """The distinct texts of columns with their day, moment and how often they occur.

    Built in one map-side combined pass and written once. ``known`` names the columns that have a dictionary, others
    are parsed row by row; a dictionary is broadcast, since its size was bounded before and is measured again.
    """

    def __init__(self, df: DataFrame, values: Mapping[str, Column], facts: Mapping[str, dict]):
        self._values = dict(values)
        self._names = [n for n in values if is_worth_it(facts[n])]
        self._table = self._parsed(df, self._names, with_counts=True) if self._names else None
        if self._table is not None:
            self._table = keep(self._table)
            if not skew.is_small(self._table):
                self._table, self._names = None, []
        self._direct = [n for n in values if n not in self._names]
        self._counts = self._counted(df)

    def _parsed(self, df: DataFrame, names: list[str], with_counts: bool) -> DataFrame:
        long = cells(df, [[self._values[n]] for n in names], ["value"]).filter("value is not null")
        if with_counts:
            long = long.groupBy(COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))
        else:
            long = long.withColumn("n", F.lit(1).cast("bigint"))
        long = dates.with_days(long, {"day": F.col("value")})
        return long.withColumn("at", dates.with_clock(F.col("day"), F.col("value"))) if with_counts else long

    def _counted(self, df: DataFrame) -> dict[str, dict]:
        found = {n: {"parsed": 0, "rewritten": 0} for n in self._values}
        rewritten = F.col("day").isNotNull() & (dates.iso_text(F.col("day")) != F.col("value"))
        sums = [F.sum(F.when(test, F.col("n")).otherwise(0)).alias(a) for a, test in (("parsed", F.col("day").isNotNull()), ("rewritten", rewritten))]
        for names, table in ((self._names, self._table), (self._direct, None)):
            if names:
                table = self._parsed(df, names, with_counts=False) if table is None else table
                for r in table.groupBy(COLUMN).agg(*sums).collect():
                    found[names[r[COLUMN]]] = {"parsed": r["parsed"], "rewritten": r["rewritten"]}
        return found

    def counts(self, name: str) -> dict:
        """Cells that parse as dates, and those not written as yyyy-MM-dd."""
        return self._counts[name]

    def _with(self, df: DataFrame, name: str, wanted: Column, out: str, value: Column) -> DataFrame:
        """df with what the dictionary says of a value."""
        entries = self._table.filter((F.col(COLUMN) == self._names.index(name)) & wanted.isNotNull())
        entries = F.broadcast(entries.select(F.col("value").alias("_gm_text"), wanted.alias(out)))
        return df.join(entries, value == F.col("_gm_text"), "left").drop("_gm_text")

    def with_moment(self, df: DataFrame, name: str, out: str) -> DataFrame:
        """df with the moment written in a column, null where it holds none."""
        if name in self._names:
            return self._with(df, name, F.col("at"), out, col(name))
        df = dates.with_days(df, {"_gm_day": col(name)})
        return settled(df, {out: dates.with_clock(F.col("_gm_day"), col(name))}).drop("_gm_day")

    def rewrite(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the dates of columns written as yyyy-MM-dd; other texts stay."""
        known = [n for n in names if n in self._names and self._counts[n]["rewritten"]]
        for n in known:
            iso = dates.iso_text(F.col("day"))
            df = self._with(df, n, F.when(iso != F.col("value"), iso), "_gm_iso", col(n))
            df = df.withColumn(n, F.coalesce("_gm_iso", col(n))).drop("_gm_iso")
        direct = [n for n in names if n in self._direct]
        if direct:
            days = {f"_gm_day{i}": col(n) for i, n in enumerate(direct)}
            iso = {n: F.coalesce(F.col(d), col(n)) for n, d in zip(direct, days)}
            df = dates.with_days(df, days, iso=True).withColumns(iso).drop(*days)
        return df
