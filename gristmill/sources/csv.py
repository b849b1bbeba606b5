"""CSV files: header, encoding, malformed lines, null tokens, types."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.constants import MALFORMED_LISTED
from gristmill.naming import ROW, col
from gristmill.operators import skew
from gristmill.operators.order import PLACE_BITS, with_file_order
from gristmill.operators.store import keep
from gristmill.sources import records
from gristmill.sources.infer import default_nulls, infer_types

NO_DATA = "There is nothing to read: the input has neither columns nor rows."
LATIN_NOTE = "Some bytes are not UTF-8, so the input was read as ISO-8859-1. Check special characters."
_BAD = "_gm_bad"
# Rows of the files of one header have numbers below 2 to this power; the header's number is above.
_GROUP_BITS = 48
# Possessive, so that long fields do not nest matches.
_QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'


def field_count(line: Column) -> Column:
    """Fields of a CSV line; commas inside quoted fields do not count."""
    plain = F.regexp_replace(line, _QUOTED, "$1")
    return F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1


def repeated_names(header: str) -> list[str]:
    """Names that occur more than once in a raw header line, in order of their second occurrence."""
    names = header.strip().split(",")
    return [n for i, n in enumerate(names) if names[:i].count(n) == 1]


def distinct_names(names: Sequence[str]) -> list[str]:
    """Column names made distinct as a, a.1, a.2; case aside, since Spark ignores it."""
    taken: set[str] = set()
    result = []
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        unique, number = base, 1
        while unique.lower() in taken:
            unique, number = f"{base}.{number}", number + 1
        taken.add(unique.lower())
        result.append(unique)
    return result


@dataclass
class CsvPart:
    """Files with equal header lines: their lines or, where records span lines, the records set aside."""

    lines: DataFrame | None
    set_aside: DataFrame | None
    fields: int
    has_header: bool

    def malformed(self) -> DataFrame:
        if self.lines is None:
            return self.set_aside
        spots = self.lines.select(
            "line",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_gm_start"),
            F.monotonically_increasing_id().alias("_gm_at"),
        )
        splits = spots.groupBy("file", "_gm_start").agg(F.count(F.lit(1)).alias("_gm_n"), F.min("_gm_at").alias("_gm_first"))
        before = Window.partitionBy("file").orderBy("_gm_start").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.withColumn("_gm_before", F.coalesce(F.sum("_gm_n").over(before), F.lit(0))).drop("_gm_n")
        long = spots.filter(field_count(F.col("line")) > self.fields)
        number = F.col("_gm_before") + F.col("_gm_at") - F.col("_gm_first") + 1
        placed = long.join(splits, ["file", "_gm_start"]).withColumn("line_number", number)
        if self.has_header:
            placed = placed.filter("line_number > 1")
        return placed.select("file", "line_number", "line")


@dataclass
class CsvTable:
    """CSV files as a table, with what was noticed while reading them."""

    df: DataFrame
    duplicate_names: list[str]
    encoding_note: str | None
    _parts: list[CsvPart]

    @cached_property
    def malformed(self) -> DataFrame:
        """(file, line_number, line) of every line left out for having too many fields.

        Line numbers start at 1 in each file and count the header and blank lines. Lines are
        numbered inside each file split, splits of a file are then added up in order. Where records
        span lines, ``line`` is the whole record and records are numbered.
        """
        return reduce(DataFrame.unionByName, [p.malformed() for p in self._parts])

    @cached_property
    def malformed_count(self) -> int:
        return self.malformed.count()

    @property
    def notes(self) -> tuple[int, list[int], str | None, list[str]]:
        """Lines left out, the first of their numbers, encoding note, repeated column names."""
        count = self.malformed_count
        return count, self.malformed_line_numbers if count else [], self.encoding_note, self.duplicate_names

    @cached_property
    def malformed_line_numbers(self) -> list[int]:
        """The first line numbers, as listed in a report."""
        first = self.malformed.orderBy("file", "line_number").limit(MALFORMED_LISTED)
        return [r["line_number"] for r in first.collect()]


def file_notes(spark: SparkSession, files: Mapping[str, CsvTable]) -> DataFrame:
    """One row per CSV input that was not read as it stands."""
    schema = (
        "name string, malformed_rows_skipped bigint, malformed_row_numbers array<bigint>, "
        "encoding_note string, duplicate_column_names array<string>"
    )
    notes = [(n, *t.notes) for n, t in files.items()]
    return spark.createDataFrame([r for r in notes if any(r[1:])], schema)


def table_and_notes(table: DataFrame | CsvTable) -> tuple[DataFrame, DataFrame | None]:
    """A table to work on, and notes about its file if it came as CSV.

    A CSV input is written once as Parquet: its text is parsed once, however many passes follow.
    """
    if not isinstance(table, CsvTable):
        return table, None
    return keep(table.df), file_notes(table.df.sparkSession, {"": table}).drop("name")


def _headers(lines: DataFrame) -> list[tuple[str, list[str]]]:
    """The different header lines, in the order of the first file of each, with the files that have them.

    A header is the first line of a file that is not blank. File names reach the driver only if there are several headers.
    """
    spots = lines.filter(F.length(F.trim("line")) > 0).select(
        F.regexp_replace("line", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_gm_at"),
    )
    per_file = spots.groupBy("file").agg(F.min_by("line", "_gm_at").alias("header"))
    found = per_file.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()
    if len(found) < 2:
        return [(r["header"], []) for r in found]
    files: dict[str, list[str]] = {r["header"]: [] for r in found}
    for r in per_file.orderBy("file").collect():
        files[r["header"]].append(r["file"])
    return list(files.items())


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    names: Sequence[str] | None = None,
    multi_line: bool = False,
    infer: bool = True,
) -> CsvTable:
    """Read CSV files with a header line each, or with given ``names`` and no header.

    Files may have different headers: their columns are matched by name, and a column that a file lacks is null.

    Bytes that are not UTF-8 anywhere make the whole input ISO-8859-1. Lines with too many
    fields are set aside, lines with too few are filled with nulls. ``multi_line`` allows line
    breaks inside quotes; such files are split among tasks, too. A quote that is never closed is
    an error then. ``infer=False`` keeps text.
    """
    lines = spark.read.text(path)
    if lines.filter(F.length("value") > 0).isEmpty():
        raise ValueError(NO_DATA)
    latin = not lines.filter(~F.is_valid_utf8("value")).isEmpty()
    if multi_line:
        pieces = records.pieces(spark, path, "\n")
        pieces = pieces.withColumn("value", _as_text("value", latin))
        if records.csv_spans_lines(pieces):
            return _read_records(records.csv_records(pieces), names, latin, infer)
    if names is not None:
        groups = [(list(names), path)]
        repeated: list[str] = []
    else:
        headers = _headers(_decoded(lines, latin))
        if not headers:
            raise ValueError(NO_DATA)
        repeated = list(dict.fromkeys(n for text, _ in headers for n in repeated_names(text)))
        groups = [(distinct_names(next(csv.reader([text]))), files or path) for text, files in headers]

    tables, parts = [], []
    for own_names, files in groups:
        # Without pruning, lines are held against the whole schema where few columns are asked for, too.
        raw = spark.read.option("columnPruning", False).csv(
            files,
            schema=_schema(own_names),
            header=names is None,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=_BAD,
            quote='"',
            escape='"',
            encoding="ISO-8859-1" if latin else "UTF-8",
        )
        # The reader marks short lines as well as long ones. It refuses to deliver the marked text
        # alone, hence the empty piece of the first column.
        marked = F.concat_ws("", F.col(_BAD), F.left(col(own_names[0]), F.lit(0)))
        whole = F.col(_BAD).isNull() | (field_count(marked) <= len(own_names))
        tables.append((raw, whole))
        parts.append(CsvPart(_decoded(spark.read.text(files), latin), None, len(own_names), names is None))
    if len(tables) == 1:
        raw, whole = tables[0]
        df = with_file_order(raw).filter(whole).drop(_BAD)
    else:
        # Files of one header follow each other; within them, rows are in the order of files and lines.
        ordered = [with_file_order(raw).filter(whole).drop(_BAD) for raw, whole in tables]
        numbered = [t.withColumn(ROW, F.col(ROW) + (i << _GROUP_BITS)) for i, t in enumerate(ordered)]
        df = _by_name(numbered)
    return _table(df, repeated, latin, parts, infer)


def _read_records(found: DataFrame, names: Sequence[str] | None, latin: bool, infer: bool) -> CsvTable:
    """A table from records (file, record_number, record); their number and that of their file are the row order."""
    found = found.filter(F.length(F.trim("record")) > 0)
    if names is not None:
        per_file = found.groupBy("file").agg(F.lit(0).alias("number"), F.lit("").alias("header"))
    else:
        per_file = found.groupBy("file").agg(F.min("record_number").alias("number"), F.min_by("record", "record_number").alias("header"))
        per_file = per_file.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))
    per_file = keep(per_file)
    headers = [r["header"] for r in per_file.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()]
    # Files of one header follow each other.
    firsts = F.min("file").over(Window.partitionBy("header"))
    ranked = per_file.withColumn("first", firsts).withColumn("rank", F.row_number().over(Window.orderBy("first", "file")))
    ranked = keep(ranked.select("file", "number", "header", "rank"))
    placed = found.join(F.broadcast(ranked) if skew.is_small(ranked) else ranked, "file").filter(F.col("record_number") > F.col("number"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
    tables, parts = [], []
    for header in headers:
        own_names = list(names) if names is not None else distinct_names(next(csv.reader(io.StringIO(header, newline=""))))
        own = placed.filter(F.col("header") == header) if len(headers) > 1 else placed
        too_long = field_count(F.col("record")) > len(own_names)
        cells = F.from_csv("record", _schema(own_names), options).alias("cells")
        row = (F.shiftleft("rank", PLACE_BITS) + F.col("record_number")).alias(ROW)
        tables.append(own.filter(~too_long).select(cells, row).select("cells.*", ROW).drop(_BAD))
        aside = own.filter(too_long).select("file", F.col("record_number").alias("line_number"), F.col("record").alias("line"))
        parts.append(CsvPart(None, aside, len(own_names), names is None))
    repeated = [] if names is not None else list(dict.fromkeys(n for text in headers for n in repeated_names(text)))
    return _table(tables[0] if len(tables) == 1 else _by_name(tables), repeated, latin, parts, infer)


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _BAD])


def _by_name(tables: Sequence[DataFrame]) -> DataFrame:
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return df.select(*[col(c) for c in df.columns if c != ROW], ROW)


def _table(df: DataFrame, repeated: list[str], latin: bool, parts: list[CsvPart], infer: bool) -> CsvTable:
    df = default_nulls(df)
    return CsvTable(infer_types(df) if infer else df, repeated, LATIN_NOTE if latin else None, parts)


def _as_text(value: str, latin: bool) -> Column:
    return F.decode(F.col(value).cast("binary"), "ISO-8859-1") if latin else F.col(value)


def _decoded(lines: DataFrame, latin: bool) -> DataFrame:
    return lines.select(_as_text("value", latin).alias("line"), "_metadata")
