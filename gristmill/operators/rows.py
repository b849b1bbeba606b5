"""Row checks of clean: empty, missing, duplicate and conflicting rows, fills."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.constants import CONFLICT_REASON, DUPLICATE_REASON, MISSING_REASON
from gristmill.functions.keys import KEY, row_key
from gristmill.naming import ROW, col
from gristmill.operators.order import number_rows
from gristmill.operators.rules import BEFORE
from gristmill.operators.skew import byte_size, fits, hot_keys, is_small, lookup
from gristmill.operators.store import keep


def review(df: DataFrame, names: Sequence[str], reason: Column) -> DataFrame:
    """Rows for a person to look at: the reason, then the cells as they were before cleaning."""
    title, taken = "reason", {n.lower() for n in names}
    while title in taken:
        title = f"_{title}"
    return df.select(reason.alias(title), *[F.col(BEFORE)[n].alias(n) for n in names], ROW)


def all_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(n).isNull() for n in names])


def any_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(n).isNull() for n in names])


def missing_reason(names: Sequence[str]) -> Column:
    named = F.array_compact(F.array(*[F.when(col(n).isNull(), F.lit(n)) for n in names]))
    return F.concat(F.lit(MISSING_REASON), F.array_join(named, ", "))


def with_row_key(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns(row_key([col(n) for n in names]))


class RepeatedRows:
    """Groups of equal rows with more than one member, counted under a fixed-width key.

    Counting combines on the map side, so a row copied into a third of the table
    leaves each task once.
    """

    def __init__(self, df: DataFrame, names: Sequence[str], total: int):
        self.rows = df if KEY[0] in df.columns else with_row_key(df, names)
        counted = self.rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_gm_n"), F.min(ROW).alias("_gm_first"))
        self.groups = keep(counted.filter("_gm_n > 1"))
        measures = (F.count(F.lit(1)), F.coalesce(F.sum("_gm_n"), F.lit(0)), byte_size(self.groups))
        self.count, self.members, size = self.groups.agg(*measures).first()
        self.extra = self.members - self.count
        self.small = fits(size)
        self.hot = None if self.small else hot_keys(self.groups, KEY, total, "_gm_n")

    def join(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        return lookup(rows, table, KEY, self.hot, how, small=self.small)

    def singles(self, rows: DataFrame) -> DataFrame:
        """Rows that have no equal."""
        if not self.count:
            return rows
        marked = self.join(rows, self.groups.select(*KEY, F.lit(True).alias("_gm_repeated")), "left")
        return marked.filter(F.col("_gm_repeated").isNull()).drop("_gm_repeated")


def duplicate_review(repeated: RepeatedRows, names: Sequence[str]) -> DataFrame:
    """Every member of every group of equal rows; groups numbered by their first row."""
    numbered = number_rows(repeated.groups, ["_gm_first", *KEY], "_gm_group").select(*KEY, "_gm_n", "_gm_group")
    rows = repeated.join(repeated.rows, numbered)
    reason = F.format_string(DUPLICATE_REASON, F.col("_gm_n") - 1, F.col("_gm_group"))
    return review(rows, names, reason)


class Conflicts:
    """Rows that share an ID with another row, differ from it, and have no exact copy."""

    def __init__(self, repeated: RepeatedRows, names: Sequence[str], id_name: str, total: int):
        self._repeated = repeated
        self._names = names
        self._id_name = id_name
        rows = repeated.rows.withColumn("_gm_id", col(id_name)).filter(F.col("_gm_id").isNotNull())
        counted = rows.groupBy("_gm_id").agg(F.count(F.lit(1)).alias("_gm_n"))
        self._ids = keep(counted.filter("_gm_n > 1"))
        # With few repeated IDs, only their rows go through the shuffle below.
        self._rows = rows
        few = is_small(self._ids)
        narrowed = lookup(rows, self._ids.select("_gm_id"), ["_gm_id"], small=True) if few else rows
        self.ids = keep(self._compare(narrowed))
        self.count, size = self.ids.agg(F.coalesce(F.sum("_gm_lone"), F.lit(0)), byte_size(self.ids)).first()
        self._small = fits(size)
        # Every ID with many rows is among the repeated ones, whether it has conflicts or not.
        self._hot = None if self._small else hot_keys(self._ids, ["_gm_id"], total, "_gm_n")

    def _compare(self, rows: DataFrame) -> DataFrame:
        """Per ID: how many rows have no exact copy, and in which columns those differ.

        Cells are compared by 64-bit hash, so all partial results are fixed-width numbers.
        """
        others = [n for n in self._names if n != self._id_name]
        cells = {f"_gm_h{i}": F.xxhash64(col(n).isNull(), col(n)) for i, n in enumerate(others)}
        distinct = (
            rows.withColumns(cells)
            .groupBy("_gm_id", *KEY)
            .agg(F.count(F.lit(1)).alias("_gm_n"), *[F.min(c).alias(c) for c in cells])
        )
        lone = {c: F.when(F.col("_gm_n") == 1, F.col(c)) for c in cells}
        per_id = distinct.groupBy("_gm_id").agg(
            F.sum("_gm_n").alias("_gm_rows"),
            F.count_if(F.col("_gm_n") == 1).alias("_gm_lone"),
            *[(F.min(v) != F.max(v)).alias(c) for c, v in lone.items()],
        )
        differing = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in zip(cells, others)]))
        differs = F.array_join(differing, ", ") if others else F.lit("")
        return per_id.filter("_gm_rows > 1 and _gm_lone > 0").select("_gm_id", "_gm_lone", differs.alias("_gm_differs"))

    def review(self) -> DataFrame:
        rows = lookup(self._rows, self.ids.drop("_gm_lone"), ["_gm_id"], self._hot, small=self._small)
        rows = self._repeated.singles(rows)
        reason = F.concat(F.lit(CONFLICT_REASON.replace("{id}", self._id_name)), F.col("_gm_differs"))
        return review(rows, self._names, reason)


def drop_repeats(repeated: RepeatedRows, names: Sequence[str]) -> DataFrame:
    """One row of each group of equal rows, the first.

    Rows without an equal pass straight through; only members of repeated groups are
    shuffled, combined on the map side. If repeated groups are too many to broadcast,
    all rows are grouped instead, which is one shuffle as well.
    """
    columns = [col(n) for n in names]
    rows = repeated.rows.select(*columns, ROW, *KEY)
    if not repeated.count:
        return rows.drop(*KEY)
    if repeated.small:
        copies = repeated.join(rows, repeated.groups.select(*KEY))
        firsts = copies.groupBy(*columns).agg(F.min(ROW).alias(ROW))
        return repeated.singles(rows).drop(*KEY).unionByName(firsts)
    return rows.groupBy(*columns).agg(F.min(ROW).alias(ROW))
