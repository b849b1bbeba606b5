"""Analyze a table: its profile, correlations, trends, group comparisons and outliers. Reads only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame

from gristmill.naming import IdNames
from gristmill.operators import metrics
from gristmill.operators.order import ensure_row_order
from gristmill.plans.profile import ProfileResult
from gristmill.sources.csv import CsvTable, table_and_notes


class AnalysisResult:
    """What analyze finds in the table as it is, not cleaned. Parts are worked out on demand."""

    file_notes: DataFrame | None = None

    def __init__(self, df: DataFrame, ids: IdNames):
        self._df = df
        self._ids = ids
        self.profile = ProfileResult(df, ids)

    @cached_property
    def correlations(self) -> DataFrame:
        return metrics.correlations(self._df, self._ids)

    @cached_property
    def _dates(self) -> metrics.Dates:
        return metrics.Dates(self._df)

    @property
    def date_columns(self) -> list[str]:
        return self._dates.columns

    @cached_property
    def trends(self) -> DataFrame:
        return metrics.trends(self._df, self._ids, self._dates)

    @cached_property
    def group_comparisons(self) -> DataFrame:
        return metrics.group_comparisons(self._df, self._ids)

    @cached_property
    def _outliers(self) -> metrics.Outliers:
        return metrics.Outliers(self._df, self._ids)

    @cached_property
    def outliers(self) -> DataFrame:
        return self._outliers.table()

    @cached_property
    def outlier_examples(self) -> DataFrame:
        return self._outliers.examples()


def analyze(df: DataFrame | CsvTable, id_columns: Iterable[str] | None = None) -> AnalysisResult:
    """Analyze a table. ``id_columns`` names the identifiers, else column names decide."""
    df, notes = table_and_notes(df)
    result = AnalysisResult(ensure_row_order(df), IdNames(id_columns))
    result.file_notes = result.profile.file_notes = notes
    return result
