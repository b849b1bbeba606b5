"""Dates written as text in mixed formats, month first unless that cannot be."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.constants import DATE_LIKE
from gristmill.functions.text import strip

_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+"
_CLOCK = (
    r"(?:t|[ ,]+)(?:(0?\d|1[0-2])(?::([0-5]\d)(?::([0-5]\d)(?:\.(\d+))?)?)?\s*([ap])m"
    r"|([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:[.,](\d+))?)?)"
    r"\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
)
_MAY_HAVE_CLOCK = "[:m]"
# The year that two-digit years lie around; None is the year of the run. Set it for runs that must repeat.
PIVOT_YEAR: int | None = None
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_SEP = "[-/. ]"

# Text shapes and the year-month-day they mean.
_NUMERIC_SHAPES = [
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"),
    (r"^(\d{4})$", "$1-1-1"),
]
_NAMED_SHAPES = [
    (rf"^{_DAY}(?: of )?[-/. ]*{_MONTH}\.?[-/,. ]*(\d{{4}}|\d{{2}})$", "$3-$2-$1"),
    (rf"^{_MONTH}\.?[-/ ]*{_DAY}[-/, ]+(\d{{4}}|\d{{2}})$", "$3-$1-$2"),
    (rf"^(\d{{4}})[-/ ]{_MONTH}[-/ ]{_DAY}$", "$1-$2-$3"),
    (rf"^{_MONTH}\.?[-/, ]+(\d{{4}})$", "$2-$1-1"),
    (rf"^(\d{{4}})[-/ ]{_MONTH}$", "$1-$2-1"),
    (r"^(\d{4})-?q([1-4])$", "$1-q$2-1"),
]


def looks_like_date(c: Column) -> Column:
    return c.rlike(DATE_LIKE)


def with_days(df: DataFrame, days: Mapping[str, Column], iso: bool = False) -> DataFrame:
    """Add the calendar day of texts, null where a text is no date: a date, or with ``iso`` as yyyy-MM-dd.

    Each step is a column of its own, so that it is worked out once however often the next
    step mentions it. Texts without letters are not held against shapes with month names.
    """
    steps = [f"_gm_step{i}" for i in range(len(days))]
    df = df.withColumns({s: F.lower(strip(c)) for s, c in zip(steps, days.values())})
    for prepare in (_without_clock, _split, _ordered, lambda c: F.split(c, "-"), _padded, _checked_text if iso else _checked):
        df = df.withColumns({s: prepare(F.col(s)) for s in steps})
    return df.withColumnsRenamed(dict(zip(steps, days)))


def _without_clock(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, _CLOCK, ""), _WEEKDAY, "")
    return F.when(text.rlike(_MAY_HAVE_CLOCK), plain).otherwise(text)


def _split(body: Column) -> Column:
    """A date text and its parts between separators, if these are digits."""
    digits = F.translate(body, "0123456789-/. ", "") == ""
    return F.struct(body.alias("body"), F.when(digits, F.split(body, _SEP)).alias("parts"))


def _three_numbers(parts: Column) -> Column:
    """Three numbers as year-month-day: a long one is the year, else the month comes first unless it cannot be one."""
    a, b, c = (F.get(parts, i) for i in range(3))
    first = a.try_cast("int")
    short = [F.length(x).between(1, 2) for x in (a, b, c)]
    year_first = F.concat_ws("-", a, b, c)
    return F.when(
        short[1],
        F.when((F.length(a) == 4) & short[2], year_first).when(
            short[0] & (short[2] | (F.length(c) == 4)),
            F.when(first.between(13, 31), F.concat_ws("-", c, b, a))
            .when((first >= 32) & short[2], year_first)
            .otherwise(F.concat_ws("-", c, a, b)),
        ),
    )


def _ordered(text: Column) -> Column:
    """A split date text as year-month-day; null if it has none of the shapes."""
    body, parts = text["body"], text["parts"]

    def first_of(shapes: list[tuple[str, str]]) -> Column:
        chain = F
        for pattern, meaning in shapes:
            chain = chain.when(body.rlike(pattern), F.regexp_replace(body, pattern, meaning))
        return chain

    numbers = F.when(F.size(parts) == 3, _three_numbers(parts)).otherwise(first_of(_NUMERIC_SHAPES))
    return F.when(parts.isNotNull(), numbers).otherwise(first_of(_NAMED_SHAPES))


def _padded(parts: Column) -> Column:
    """Year, month and day as yyyy-MM-dd; years have two or four digits, months may have names."""
    digits, month, day = (F.get(parts, i) for i in range(3))
    # Two-digit years fall within 50 years of today, or of a fixed year.
    pivot = F.year(F.current_date()) + 50 - 2000 if PIVOT_YEAR is None else F.lit(PIVOT_YEAR + 50 - 2000)
    century = F.when(digits.try_cast("int") >= pivot, "19").otherwise("20")
    year = F.when(F.length(digits) == 4, digits).otherwise(F.concat(century, F.lpad(digits, 2, "0")))
    named = F.floor((F.instr(F.lit(_MONTHS), F.substring(month, 1, 3)) + 2) / 3).cast("string")
    month = (
        F.when(month.rlike(r"^\d"), month)
        .when(month.startswith("q"), (F.substring(month, 2, 1).try_cast("int") * 3 - 2).cast("string"))
        .otherwise(named)
    )
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def _covered(padded: Column) -> Column:
    """The years a 64-bit nanosecond clock covers whole."""
    return padded.between("1678-01-01", "2261-12-31")


def _checked(padded: Column) -> Column:
    return F.when(_covered(padded), padded.try_cast("date"))


def _checked_text(padded: Column) -> Column:
    return F.when(_covered(padded) & padded.try_cast("date").isNotNull(), padded)


def with_clock(day: Column, c: Column) -> Column:
    """A parsed day together with the clock time written in its text."""
    text = F.lower(strip(c))

    def part(group: int) -> Column:
        return F.regexp_extract(text, _CLOCK, group)

    half_day = part(5) != ""
    hour = F.when(half_day, part(1).try_cast("int") % 12 + F.when(part(5) == "p", 12).otherwise(0)).otherwise(
        part(6).try_cast("int")
    )
    minute = F.when(half_day, part(2)).otherwise(part(7)).try_cast("int")
    second = F.when(half_day, F.concat_ws(".", part(3), F.nullif(part(4), F.lit("")))).otherwise(
        F.concat_ws(".", part(8), F.nullif(part(9), F.lit("")))
    ).try_cast("double")
    clock = F.make_dt_interval(
        F.lit(0),
        F.coalesce(hour, F.lit(0)),
        F.coalesce(minute, F.lit(0)),
        F.coalesce(second, F.lit(0.0)).cast("decimal(18,6)"),
    )
    midnight = day.cast("timestamp_ntz")
    return F.when(text.rlike(_MAY_HAVE_CLOCK), midnight + clock).otherwise(midnight)


def iso_text(day: Column) -> Column:
    return day.cast("date").cast("string")
