"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.constants import LEADING_ZERO

# try_cast alone would also take "1d" and "1f".
NUMBER = r"^(?i)[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)$"
WHOLE = r"^[+-]?\d+$"


def may_be_number(stripped: Column) -> Column:
    """A quick look at the first character spares most words the pattern."""
    first = F.ascii(stripped)
    return first.between(ord("+"), ord("9")) | first.isin(ord("i"), ord("I"))


def is_number_text(stripped: Column) -> Column:
    return stripped.rlike(NUMBER)


def is_whole_text(stripped: Column) -> Column:
    """Whole numbers that a bigint holds."""
    return stripped.rlike(WHOLE) & stripped.try_cast("bigint").isNotNull()


def is_long_digits(stripped: Column) -> Column:
    """Digits beyond a bigint, which a number would not keep exactly."""
    return stripped.rlike(WHOLE) & stripped.try_cast("bigint").isNull()


def is_code(stripped: Column) -> Column:
    """Numbers with leading zeros are codes, such as postal codes."""
    return stripped.rlike(LEADING_ZERO)


def to_number(c: Column, type_name: str) -> Column:
    return c.try_cast(type_name)


def no_nan(c: Column, type_name: str) -> Column:
    """NaN is a missing value."""
    if type_name in ("double", "float"):
        return F.when(~F.isnan(c), c)
    return c
