"""Text cells: trimming, missing-value markers, categories, compact keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.constants import BLANK_MARKERS, CATEGORY_GROUPS

# Every character Python's str.strip() removes. Spark's trim() alone removes spaces only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_LONGEST_MARKER = max(len(m) for m in BLANK_MARKERS)
_LONGEST_CATEGORY = max(len(k) for group in CATEGORY_GROUPS for k in group)

KEY_BYTES = 48


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def short_lower(stripped: Column) -> Column:
    """A short text in lower case, null if it is too long for a marker or a category."""
    return F.when(F.octet_length(stripped) <= max(_LONGEST_MARKER, _LONGEST_CATEGORY), F.lower(stripped))


def is_blank(stripped: Column) -> Column:
    """True where an already stripped text is a missing-value marker."""
    return F.coalesce(short_lower(stripped).isin(BLANK_MARKERS), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(strip(c)), c)


def tidy(c: Column) -> Column:
    """Markers to null, everything else trimmed."""
    return F.when(~is_blank(strip(c)), strip(c))


def category(stripped: Column, group: dict[str, str]) -> Column:
    """The group's spelling of a value, or null where the value is not in the group."""
    return spelled(short_lower(stripped), group)


def spelled(lower: Column, group: dict[str, str]) -> Column:
    chain = F
    for key, spelling in group.items():
        chain = chain.when(lower == key, spelling)
    return chain


def may_have_case(c: Column) -> Column:
    """False only where a text surely has one spelling: no ASCII letter, nothing beyond ASCII."""
    return c.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")


def compact(c: Column) -> Column:
    """A short stand-in for a text in shuffles: the text itself up to 48 bytes, else its digest.

    Whole texts take part; only the copy that travels through a shuffle is short.
    """
    return F.when(F.octet_length(c) <= KEY_BYTES, c).otherwise(
        F.concat(F.lit("\u0000"), F.md5(c), F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    )


def is_digest(key: Column) -> Column:
    """A digest is 49 bytes long, one more than any text that is its own key."""
    return F.octet_length(key) > KEY_BYTES


def key_text(c: Column, type_name: str) -> Column:
    """A key as text, alike for equal values of different types: 1 and 1.00, a date and its midnight."""
    if type_name.startswith("decimal"):
        plain = F.when(c != 0, c.cast("string")).otherwise("0")
        return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    if type_name.startswith("timestamp"):
        return F.regexp_replace(c.cast("string"), r" 00:00:00$", "")
    return as_text(c, type_name)


def as_text(c: Column, type_name: str, fraction: str = "") -> Column:
    """A cell as text: booleans as True/False, whole numbers in plain digits.

    ``fraction`` follows whole numbers of a fractional type.
    """
    if type_name == "boolean":
        return F.when(c, "True").when(~c, "False")
    if type_name in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) <= float(1 << 53))
        return F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(fraction))).otherwise(c.cast("string"))
    return c.cast("string")
