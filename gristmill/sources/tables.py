"""Reading tables by file type, finding them in a folder, writing results."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import dates
from gristmill.naming import ROW, col, is_text
from gristmill.operators.order import PLACE_BITS, with_file_order, with_row_order
from gristmill.plans.clean import CleanResult
from gristmill.plans.gather import GatherResult
from gristmill.sources import records
from gristmill.sources.csv import NO_DATA, CsvTable, read_csv
from gristmill.sources.infer import infer_types

EXTENSIONS = [".csv", ".json", ".jsonl", ".parquet"]

# JSON columns with these names hold dates.
_DATE_NAME_ENDS = ("_at", "_time")
_DATE_NAME_STARTS = ("timestamp",)
_DATE_NAMES = ("modified", "date")


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Read an array of records, or with ``lines`` one record per line; both are split among tasks.

    Columns come in the order of the first record. Text that holds numbers only becomes
    numbers; columns named like dates become timestamps if all their texts are dates. A file
    that holds one record and no array is read by one task.
    """
    found = None if lines else records.json_array_records(spark, path)
    if found is not None:
        # Types are inferred as for any JSON input; the reader takes texts on the JVM's side only.
        texts = getattr(found.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().json(texts), spark).schema
        placed = found.join(records.file_ranks(found), "file")
        row = (F.shiftleft("rank", PLACE_BITS) + F.col("record_number")).alias(ROW)
        df = placed.select(F.from_json("record", schema).alias("cells"), row).select("cells.*", ROW)
        first = placed.orderBy("rank", "record_number").select("record")
    else:
        df = spark.read.json(path, multiLine=not lines)
        texts_ = spark.read.text(path, wholetext=not lines)
        first = texts_.filter(F.length(F.trim("value")) > 0).select(F.col("value").alias("record"))
    names = [c for c in df.columns if c != ROW]
    if not names:
        raise ValueError(NO_DATA)
    head = first.limit(1).select(F.json_object_keys("record")).first()
    keys = (head[0] if head else None) or []
    ordered = [k for k in keys if k in names]
    ordered += [c for c in names if c not in ordered]
    df = df.select(*[col(c) for c in ordered], *([ROW] if found is not None else []))
    df = _named_dates(infer_types(df))
    return df if found is not None else with_row_order(df)


def _is_date_name(name: str) -> bool:
    lower = name.lower()
    return lower.endswith(_DATE_NAME_ENDS) or lower.startswith(_DATE_NAME_STARTS) or lower in _DATE_NAMES


def _named_dates(df: DataFrame) -> DataFrame:
    named = [f.name for f in df.schema.fields if is_text(f.dataType) and _is_date_name(f.name)]
    if not named:
        return df
    work = dates.with_days(df, {f"_gm_day{i}": col(n) for i, n in enumerate(named)})
    tests = [F.bool_and(col(n).isNull() | F.col(f"_gm_day{i}").isNotNull()) for i, n in enumerate(named)]
    filled = [F.count(col(n)) > 0 for n in named]
    verdict = work.agg(*[t & f for t, f in zip(tests, filled)]).first()
    moments = {n: dates.with_clock(F.col(f"_gm_day{i}"), col(n)) for i, n in enumerate(named) if verdict[i]}
    return work.withColumns(moments).select(*[col(c) for c in df.columns]) if moments else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_file_order(spark.read.parquet(path), row_index=True)


def read_table(spark: SparkSession, path: str) -> DataFrame | CsvTable:
    """Read a file by its extension. CSV gives a CsvTable, whose ``df`` is the table."""
    kind = extension(path)
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".json":
        return read_json(spark, path)
    if kind == ".jsonl":
        return read_json(spark, path, lines=True)
    if kind == ".parquet":
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported file type {kind!r}. Supported: {', '.join(EXTENSIONS)}.")


def read_tables(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame | CsvTable]:
    """Two or more files by their names, or all data files of one folder, ready for gather()."""
    paths = list(paths)
    if len(paths) == 1 and extension(paths[0]) not in EXTENSIONS:
        paths = discover(spark, paths[0])
    if len(paths) < 2:
        raise ValueError(f"at least two files are needed, found {len(paths)}")
    return {os.path.basename(p.rstrip("/")): read_table(spark, p) for p in paths}


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files directly inside a folder, sorted by name, hidden ones left out.

    A folder such as orders.parquet, as Spark writes it, counts as one data file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    name = F.split_part(F.expr("substring(below, length(root) + 2)"), F.lit("/"), F.lit(1))
    found = listed.select("path", below.alias("below"), F.lit(root).alias("root")).select("path", name.alias("name"))
    wanted = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(EXTENSIONS) & ~F.col("name").startswith(".")
    names = sorted(r["name"] for r in found.filter(wanted).select("name").distinct().collect())
    return [f"{folder.rstrip('/')}/{n}" for n in names]


def write_table(df: DataFrame, path: str, fmt: str | None = None, ordered: bool = False) -> str:
    """Write a table as CSV, JSON records or Parquet; ``ordered`` sorts it by row order first."""
    fmt = fmt or extension(path).lstrip(".")
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"Unsupported file type {fmt!r} for writing.")
    if ROW in df.columns:
        df = (df.orderBy(ROW) if ordered else df).drop(ROW)
    options = {"header": True, "quote": '"', "escape": '"'} if fmt == "csv" else {}
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)
    return path


def write_clean(result: CleanResult, folder: str, fmt: str = "parquet", ordered: bool = False) -> dict[str, str]:
    """Write the cleaned table and every review table that has rows. Returns the paths by name."""
    written = {"cleaned": result.cleaned}
    counts = result.counts
    if result.duplicate_members:
        written["duplicates"] = result.duplicates
    if counts["conflicting_duplicate_rows"]:
        written["conflicts"] = result.conflicts
    if counts["rows_with_missing_values"]:
        written["missing_values"] = result.missing
    if counts["empty_rows_removed"]:
        written["empty_rows"] = result.empty
    return {n: write_table(df, f"{folder}/{n}.{fmt}", fmt, ordered) for n, df in written.items()}


def write_gather(result: GatherResult, folder: str, fmt: str = "parquet", ordered: bool = False) -> dict[str, str]:
    """Write the joined table, or each table under its own name.

    ``ordered`` writes the joined rows in the order of their keys, over files that follow each other, and tables kept
    apart in their row order.
    """
    tables: Mapping[str, DataFrame] = result.tables or {"gathered": result.joined_in_order if ordered else result.joined}
    return {n: write_table(df, f"{folder}/{n}.{fmt}", fmt, ordered) for n, df in tables.items()}
