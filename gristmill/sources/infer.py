"""Types of text columns, decided from all their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.constants import CSV_NULL_TOKENS
from gristmill.functions import numbers, text
from gristmill.naming import col, is_text
from gristmill.operators.cells import COLUMN, cells

_TRUE = ["True", "TRUE", "true"]
_FALSE = ["False", "FALSE", "false"]


def default_nulls(df: DataFrame) -> DataFrame:
    """The reader's null tokens become null, exactly as written and untrimmed."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.when(~col(n).isin(CSV_NULL_TOKENS), col(n)).alias(n) if is_text(types[n]) else col(n)
            for n in df.columns
        ]
    )


def column_types(df: DataFrame) -> dict[str, str]:
    """The type each text column deserves: bigint, double, boolean or string. One scan.

    Whole numbers stay whole numbers with gaps among them, so no digit is lost.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n, t in types.items() if is_text(t)]
    if not names:
        return {}
    value, stripped = F.col("value"), text.strip(F.col("value"))
    facts = (
        cells(df, [[col(n)] for n in names], ["value"])
        .groupBy(COLUMN)
        .agg(
            F.count(value).alias("filled"),
            F.count_if(numbers.is_number_text(stripped)).alias("numbers"),
            F.count_if(numbers.is_whole_text(stripped)).alias("whole"),
            F.count_if(numbers.is_code(stripped) | numbers.is_long_digits(stripped)).alias("codes"),
            F.count_if(value.isin(_TRUE + _FALSE)).alias("flags"),
        )
        .collect()
    )
    found = dict.fromkeys(names, "string")
    for f in facts:
        if not f["filled"]:
            continue
        name = names[f[COLUMN]]
        if f["numbers"] == f["filled"] and not f["codes"]:
            found[name] = "bigint" if f["whole"] == f["filled"] else "double"
        elif f["flags"] == f["filled"]:
            found[name] = "boolean"
    return found


def infer_types(df: DataFrame) -> DataFrame:
    """Cast every text column whose cells all read as numbers or flags.

    Codes stay text: leading zeros, and digits too many for a whole number.
    """
    kinds = column_types(df)
    columns = []
    for name in df.columns:
        kind = kinds.get(name, "string")
        value = col(name)
        if kind in ("bigint", "double"):
            value = numbers.to_number(text.strip(value), kind)
        elif kind == "boolean":
            value = value.isin(_TRUE)
        columns.append(value.alias(name))
    return df.select(*columns)
