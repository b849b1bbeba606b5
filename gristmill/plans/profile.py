"""Profile a table: shape, per-column statistics and quality signals. Reads only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.constants import DUPLICATE_ROW_EXAMPLES
from gristmill.functions import numbers
from gristmill.functions.keys import KEY
from gristmill.naming import ROW, IdNames, col, data_columns
from gristmill.operators import columns as stats
from gristmill.operators.order import ensure_row_order
from gristmill.operators.quantiles import exact_quantiles
from gristmill.operators.rows import RepeatedRows
from gristmill.sources.csv import CsvTable, table_and_notes

EMPTY_WARNING = "The table has no rows to profile."

_COLUMN_SCHEMA = (
    "column string, dtype string, null_count bigint, null_percent double, all_values_null boolean, "
    "unique_count bigint, mean double, median double, min double, max double, "
    "blank_like_count bigint, duplicate_value_count bigint"
)


class ProfileResult:
    """What profile finds. Each part is worked out when first asked for.

    ``table`` (metric, value): rows, columns and repeated rows. ``columns``: one row per column.
    ``top_values``, ``casing_examples``, ``duplicate_values`` and ``duplicate_row_examples``
    hold the examples behind the counts. ``file_notes`` tells what was noticed in a CSV input, else it is None.
    """

    file_notes: DataFrame | None = None

    def __init__(self, df: DataFrame, ids: IdNames):
        self._spark = df.sparkSession
        types = dict(df.dtypes)
        self.names = data_columns(df)
        self._types = types
        self._ids = ids
        self._df = df.select(*[numbers.no_nan(col(n), types[n]).alias(n) for n in self.names], ROW)
        self.numeric = [n for n in self.names if stats.as_double(df, n) is not None]
        self.other = [n for n in self.names if n not in self.numeric]

    @cached_property
    def _basics(self) -> dict[str, dict]:
        return stats.number_stats(self._df, self.names)

    @cached_property
    def row_count(self) -> int:
        return next(iter(self._basics.values()))["rows"]

    @cached_property
    def warning(self) -> str | None:
        return None if self.row_count else EMPTY_WARNING

    @cached_property
    def _medians(self) -> dict[str, list[float] | None]:
        counts = {n: self._basics[n]["filled"] for n in self.numeric}
        return exact_quantiles(self._df, {n: stats.as_double(self._df, n) for n in self.numeric}, [0.5], counts)

    @cached_property
    def blank_like(self) -> dict[str, int]:
        """Cells of text columns that hold a missing-value marker."""
        texts = [n for n in self.other if self._types[n] == "string"]
        found = dict(stats.blank_counts(self._df, texts).collect()) if texts else {}
        return {n: found.get(n, 0) for n in self.other}

    @cached_property
    def _values(self) -> stats.ColumnValues:
        return stats.ColumnValues(self._df, self.names)

    @cached_property
    def value_facts(self) -> dict[str, dict]:
        """Per column: distinct values, filled cells, and copies beyond the first of each value."""
        none = {"unique": 0, "filled": 0, "extra": 0}
        found = self._values.facts()
        return {n: found.get(n, none) for n in self.names}

    @cached_property
    def _duplicate_values(self) -> tuple[dict[str, int], DataFrame]:
        return stats.repeated_values(self._values, self.value_facts, self._ids)

    @property
    def duplicate_values(self) -> DataFrame:
        """(column, rank, value, n) of columns that look unique and are not."""
        return self._duplicate_values[1]

    @cached_property
    def top_values(self) -> DataFrame:
        return self._values.most_frequent(self.other)

    @cached_property
    def casing_examples(self) -> DataFrame:
        return self._values.casing_examples(self.other)

    @cached_property
    def _repeated(self) -> RepeatedRows:
        return RepeatedRows(self._df, self.names, self.row_count)

    @cached_property
    def duplicate_row_examples(self) -> DataFrame:
        """The first rows that have an equal. They belong to the groups seen first."""
        first = self._repeated.groups.orderBy("_gm_first").limit(DUPLICATE_ROW_EXAMPLES).select(*KEY)
        rows = self._repeated.rows.join(F.broadcast(first), KEY, "left_semi")
        return rows.select(*[col(n) for n in self.names], ROW).orderBy(ROW).limit(DUPLICATE_ROW_EXAMPLES)

    @cached_property
    def table(self) -> DataFrame:
        return self._spark.createDataFrame(
            [
                ("row_count", self.row_count),
                ("column_count", len(self.names)),
                ("duplicate_row_count", self._repeated.extra),
            ],
            "metric string, value bigint",
        )

    @cached_property
    def columns(self) -> DataFrame:
        records = []
        extra = self._duplicate_values[0] if self.row_count else {}
        for n in self.names:
            if not self.row_count:
                break
            basics, values = self._basics[n], self.value_facts[n]
            nulls = basics["rows"] - basics["filled"]
            median = self._medians.get(n)
            records.append(
                (
                    n,
                    self._types[n],
                    nulls,
                    nulls / basics["rows"] * 100,
                    nulls == basics["rows"],
                    values["unique"],
                    basics.get("mean"),
                    median[0] if median else None,
                    basics.get("min"),
                    basics.get("max"),
                    self.blank_like.get(n),
                    extra.get(n),
                )
            )
        table = self._spark.createDataFrame(records, _COLUMN_SCHEMA)
        rounded = {n: F.round(n, stats.STAT_DIGITS) for n in ("mean", "median", "min", "max")}
        return table.withColumns({**rounded, "null_percent": F.round("null_percent", stats.PERCENT_DIGITS)})


def profile(df: DataFrame | CsvTable, id_columns: Iterable[str] | None = None) -> ProfileResult:
    """Profile a table. ``id_columns`` names the identifiers, else column names decide."""
    df, notes = table_and_notes(df)
    result = ProfileResult(ensure_row_order(df), IdNames(id_columns))
    result.file_notes = notes
    return result
