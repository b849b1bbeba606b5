"""Column names: quoting, ID detection, matching between tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.constants import ID_CAMEL_END, ID_WORD

ROW = "_row"

# Helper columns begin with this; tables with such a column are refused, so no helper hides a column.
RESERVED = "_gm_"

_ID_PATTERNS = [re.compile(ID_WORD), re.compile(ID_CAMEL_END)]


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    """Every column but the row order key. Nested columns and names with the helpers' prefix are refused."""
    names = []
    for field in df.schema.fields:
        if field.name == ROW:
            continue
        if field.name.lower().startswith(RESERVED):
            raise ValueError(f"column {field.name!r}: names with {RESERVED!r} are taken by helper columns")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise TypeError(
                f"column {field.name!r} is {field.dataType.simpleString()}; "
                "turn it into text first, for example with nested_to_text()"
            )
        names.append(field.name)
    return names


def nested_to_text(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs written out as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
            for f in df.schema.fields
        ]
    )


def is_id_name(name: str) -> bool:
    """True for id, order_id, "Order ID", customerID; false for width, valid, paid."""
    return any(p.search(str(name).strip()) for p in _ID_PATTERNS)


class IdNames:
    """Which columns are identifiers: told by the caller, or by their names."""

    def __init__(self, given: Iterable[str] | None = None):
        self._given = None if given is None else list(given)

    def __contains__(self, name: str) -> bool:
        return is_id_name(name) if self._given is None else name in self._given

    def first(self, names: Sequence[str]) -> str | None:
        return next((n for n in names if n in self), None)


def match_name(name: str) -> str:
    """The form under which column names of different tables are compared."""
    return str(name).strip().lower()


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def metric_columns(df: DataFrame, ids: IdNames) -> list[str]:
    """Numeric columns that are not identifiers. Booleans are not numbers here."""
    return [
        f.name
        for f in df.schema.fields
        if f.name != ROW and is_number(f.dataType) and f.name not in ids
    ]
