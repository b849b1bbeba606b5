"""Clean a table: repair columns, set doubtful rows aside, fill gaps, drop duplicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.constants import ALL_EMPTY, RULE_NAMES, TEXT_FILL
from gristmill.functions.keys import KEY
from gristmill.naming import ROW, IdNames, col, data_columns, is_number
from gristmill.operators.order import ensure_row_order
from gristmill.operators.quantiles import exact_quantiles
from gristmill.operators.rows import (
    Conflicts,
    RepeatedRows,
    all_null,
    any_null,
    drop_repeats,
    duplicate_review,
    missing_reason,
    review,
    with_row_key,
)
from gristmill.operators.rules import Rules, apply, decide
from gristmill.operators.store import keep
from gristmill.sources.csv import CsvTable, table_and_notes

_EMPTY, _MISSING = "_gm_is_empty", "_gm_is_missing"


class CleanResult:
    """The outcome of clean. Every table is a DataFrame; each is worked out when first asked for.

    ``cleaned`` holds the final rows; ``duplicates``, ``conflicts``, ``missing`` and ``empty``
    hold rows for review with a ``reason`` and the cells as they were. ``summary`` has one
    (metric, value) row per count, ``column_report`` one (column, metric, value) row per
    column and rule that changed cells. All tables carry the row order in ``_row``. ``file_notes``
    tells what was noticed while a CSV input was read; it is None for other inputs.
    """

    file_notes: DataFrame | None = None

    def __init__(self, df: DataFrame, rules: Rules, ids: IdNames):
        self.rules = rules
        self.names = [c.name for c in rules.columns]
        self.id_column = ids.first(self.names)
        self._spark = df.sparkSession
        self._df = df
        self._checked = [n for n in self.names if n != self.id_column] or self.names

    @cached_property
    def _applied(self) -> DataFrame:
        """All rows after the rules, with their originals and row keys, written once.

        The checks below read single columns of the written rows instead of running the rules
        over the source again, and rows and their order stay the same for all of them.
        """
        rows = with_row_key(apply(self._df, self.rules), self.names)
        return keep(rows.withColumns({_EMPTY: all_null(self._checked), _MISSING: any_null(self.names)}))

    @cached_property
    def _kept(self) -> DataFrame:
        return self._applied.filter(~F.col(_EMPTY))

    @cached_property
    def _counts(self) -> dict[str, int]:
        """Rows in all, empty, with missing values, and nulls per column among the rows kept."""
        is_kept = ~F.col(_EMPTY)
        row = self._applied.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(_EMPTY)).alias("empty"),
            F.count_if(is_kept & F.col(_MISSING)).alias("missing"),
            *[F.count_if(is_kept & col(n).isNull()).alias(f"n{i}") for i, n in enumerate(self.names)],
        ).first()
        return row.asDict()

    @property
    def _kept_rows(self) -> int:
        return self._counts["rows"] - self._counts["empty"]

    @cached_property
    def nulls(self) -> dict[str, int]:
        return {n: self._counts[f"n{i}"] for i, n in enumerate(self.names)}

    @cached_property
    def fills(self) -> dict[str, object]:
        """The value that replaces nulls, per column that has both nulls and values."""
        types = {f.name: f.dataType for f in self._kept.schema.fields}
        gaps = [n for n in self.names if 0 < self.nulls[n] < self._kept_rows]
        numeric = [n for n in gaps if is_number(types[n])]
        filled = {n: self._kept_rows - self.nulls[n] for n in numeric}
        medians = exact_quantiles(self._kept, {n: col(n).cast("double") for n in numeric}, [0.5], filled)
        fills = {n: TEXT_FILL for n in gaps if isinstance(types[n], T.StringType)}
        fills.update({n: m[0] for n, m in medians.items() if m})
        return fills

    @cached_property
    def _beyond_double(self) -> set[str]:
        """Whole-number columns to fill that hold numbers a double does not keep exactly."""
        types = {f.name: f.dataType for f in self._kept.schema.fields}
        whole = [n for n in self.fills if isinstance(types[n], T.LongType)]
        if not whole:
            return set()
        limit = 1 << 53
        row = self._kept.agg(*[F.bool_or((col(n) > limit) | (col(n) < -limit)) for n in whole]).first()
        return {n for n, beyond in zip(whole, row) if beyond}

    def _filled_type(self, name: str, kind: T.DataType) -> T.DataType:
        """The type of a filled column. A median may have a fraction: whole numbers turn double, or decimal
        where a double would lose digits; decimals get one more place."""
        if isinstance(kind, T.IntegralType):
            return T.DecimalType(20, 1) if name in self._beyond_double else T.DoubleType()
        if isinstance(kind, T.DecimalType):
            roomy = kind.precision < 38
            return T.DecimalType(kind.precision + 1, kind.scale + 1) if roomy else kind
        return kind

    @cached_property
    def _filled(self) -> DataFrame:
        types = {f.name: f.dataType for f in self._kept.schema.fields}
        columns = {}
        for name, value in self.fills.items():
            kind = self._filled_type(name, types[name])
            columns[name] = F.coalesce(col(name).cast(kind), F.lit(value).cast(kind))
        return self._kept.withColumns(columns) if columns else self._kept

    @cached_property
    def _repeated(self) -> RepeatedRows:
        """Equal rows after the rules, before the fills."""
        return RepeatedRows(self._kept, self.names, self._kept_rows)

    @cached_property
    def _repeated_filled(self) -> RepeatedRows:
        """Equal rows after the fills, which may make more rows equal."""
        if not self.fills:
            return self._repeated
        return RepeatedRows(self._filled.drop(*KEY), self.names, self._kept_rows)

    @cached_property
    def _conflicts(self) -> Conflicts | None:
        if self.id_column is None:
            return None
        return Conflicts(self._repeated, self.names, self.id_column, self._kept_rows)

    def _none(self) -> DataFrame:
        return review(self._kept.limit(0), self.names, F.lit(None).cast("string"))

    @cached_property
    def empty(self) -> DataFrame:
        return review(self._applied.filter(_EMPTY), self.names, F.lit(ALL_EMPTY))

    @cached_property
    def missing(self) -> DataFrame:
        return review(self._kept.filter(_MISSING), self.names, missing_reason(self.names))

    @cached_property
    def duplicates(self) -> DataFrame:
        return duplicate_review(self._repeated, self.names) if self._repeated.count else self._none()

    @cached_property
    def conflicts(self) -> DataFrame:
        return self._conflicts.review() if self._conflicts and self._conflicts.count else self._none()

    @cached_property
    def repaired(self) -> DataFrame:
        """All rows after the column rules, empty rows and gaps still in. Written rows are read if there are any."""
        rows = self._applied if "_applied" in self.__dict__ else apply(self._df, self.rules)
        return rows.select(*[col(n) for n in self.names], ROW)

    @cached_property
    def filled(self) -> DataFrame:
        """All rows but the empty ones, gaps filled, duplicates still in."""
        return self._filled.select(*[col(n) for n in self.names], ROW)

    @cached_property
    def cleaned(self) -> DataFrame:
        return drop_repeats(self._repeated_filled, self.names)

    @cached_property
    def counts(self) -> dict[str, int]:
        removed = self._repeated_filled.extra
        return {
            "original_row_count": self._counts["rows"],
            "empty_rows_removed": self._counts["empty"],
            "rows_with_missing_values": self._counts["missing"],
            "duplicate_rows_removed": removed,
            "conflicting_duplicate_rows": self._conflicts.count if self._conflicts else 0,
            "final_row_count": self._kept_rows - removed,
        }

    @property
    def duplicate_members(self) -> int:
        """Rows in the duplicates table."""
        return self._repeated.members

    @property
    def warning(self) -> str | None:
        return None if self._counts["rows"] else "The table has no rows to clean."

    @cached_property
    def summary(self) -> DataFrame:
        return self._spark.createDataFrame(list(self.counts.items()), "metric string, value bigint")

    @cached_property
    def changes(self) -> list[tuple[str, str, int]]:
        fills = [(n, "missing_values_filled", self.nulls[n]) for n in self.names if n in self.fills]
        order = {n: i for i, n in enumerate(self.names)}
        return sorted(self.rules.changes() + fills, key=lambda c: (order[c[0]], RULE_NAMES.index(c[1])))

    @cached_property
    def column_report(self) -> DataFrame:
        return self._spark.createDataFrame(self.changes, "column string, metric string, value bigint")


def clean(df: DataFrame | CsvTable, id_columns: Iterable[str] | None = None, keep_timestamps: bool = False) -> CleanResult:
    """Clean a table.

    ``id_columns`` names the identifiers, else column names decide. ``keep_timestamps`` leaves
    date and time columns typed instead of writing them as yyyy-MM-dd text. Row order is the
    ``_row`` column if there is one (see with_row_order), else the order of the scan.
    """
    df, notes = table_and_notes(df)
    df = ensure_row_order(df)
    if not data_columns(df):
        raise ValueError("the table has no columns")
    ids = IdNames(id_columns)
    result = CleanResult(df, decide(df, ids, keep_timestamps), ids)
    result.file_notes = notes
    return result
