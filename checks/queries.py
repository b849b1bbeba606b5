"""One query per operator. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gristmill as g
from checks.messy import (
    CUSTOMER_FIELDS,
    CUSTOMER_LINES,
    DATED_ORDERS,
    KEYED_CUSTOMERS,
    KEYED_ORDERS,
    KEYED_SEGMENTS,
    PLAIN_TEXTS,
    dealt_out,
    derived,
    messy_orders,
    table,
)
from gristmill.constants import CATEGORY_GROUPS
from gristmill.functions import text
from gristmill.naming import ROW, IdNames
from gristmill.operators import metrics
from gristmill.operators.order import number_rows
from gristmill.operators.store import keep, shared_folder
from gristmill.plans.gather import choose_key, overlap_scores, possible_keys, shared_columns

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Keys of the test tables whose names do not tell that they are identifiers.
ORDER_IDS = ["o_orderkey", "o_custkey"]
LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey"]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def numbered(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.col(ROW).alias("row_no"), *columns)


def by_row(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(ROW, "row_no")


def loud(c: Column) -> Column:
    """ASCII letters in upper case. Engines differ on other alphabets, as for the German ß."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/checks/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Column rules


@query
def blank_to_null(spark, sf_dir):
    df = messy_orders(spark, sf_dir)
    return numbered(df, text.blank_to_null(F.col("status")).alias("status"), text.blank_to_null(F.col("amount")).alias("amount"))


@query
def trim_whitespace(spark, sf_dir):
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("  \n"))
    trimmed = table(spark, sf_dir, "documents").select("doc_id", text.strip(padded).alias("trimmed"))
    return trimmed.select("doc_id", F.length("trimmed").cast("bigint").alias("chars"), F.md5("trimmed").alias("digest"))


def repaired(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return numbered(g.clean(messy_orders(spark, sf_dir).select(column, ROW)).repaired, column)


@query
def standardize_dates(spark, sf_dir):
    return repaired(spark, sf_dir, "order_date")


@query
def standardize_categories(spark, sf_dir):
    return repaired(spark, sf_dir, "urgent")


@query
def category_groups(spark, sf_dir):
    """Every value of every group, from flags spread over all orders."""
    flags = F.element_at(
        F.array(*[F.lit(k) for group in CATEGORY_GROUPS for k in group]),
        (F.col("o_orderkey") % F.lit(sum(len(x) for x in CATEGORY_GROUPS)) + 1).cast("int"),
    )
    df = table(spark, sf_dir, "orders").select("o_orderkey", flags.alias("flag"))
    return df.select(
        "o_orderkey", "flag", *[text.category(F.col("flag"), x).alias(f"as{i}") for i, x in enumerate(CATEGORY_GROUPS)]
    )


@query
def standardize_casing(spark, sf_dir):
    return numbered(g.clean(messy_orders(spark, sf_dir).select("status", "priority", ROW)).repaired, "status", "priority")


@query
def casing_first_seen(spark, sf_dir):
    """Spellings of whole texts that occur equally often: the first one in row order stays."""
    docs = keep(dealt_out(table(spark, sf_dir, "documents").select("doc_id", "text")))
    twice = docs.withColumn("copy", F.lit(0)).unionByName(
        docs.select("doc_id", loud(F.col("text")).alias("text"), F.lit(1).alias("copy"))
    )
    df = g.with_row_order(twice.select("text", "doc_id", "copy"), "doc_id * 2 + copy").select("text", ROW)
    result = g.clean(df).repaired
    return numbered(result, F.md5("text").alias("digest"))


@query
def convert_numbers(spark, sf_dir):
    return numbered(g.clean(messy_orders(spark, sf_dir).select("amount", ROW)).repaired, F.round("amount", 4).alias("amount"))


@query
def change_counts(spark, sf_dir):
    return g.clean(messy_orders(spark, sf_dir)).column_report


@query
def fill_missing(spark, sf_dir):
    filled = g.clean(messy_orders(spark, sf_dir)).filled
    return by_row(filled.withColumn("amount", F.round("amount", 4)))


@query
def keep_leading_zero_codes(spark, sf_dir):
    """Codes with leading zeros stay text, the same numbers without zeros become numbers."""
    code = F.lpad(F.col("c_nationkey").cast("string"), 3, "0")
    df = table(spark, sf_dir, "customer").select(
        code.alias("code"), F.col("c_nationkey").cast("string").alias("number"), F.col("c_custkey").alias(ROW)
    )
    result = g.clean(df).repaired
    kinds = F.concat_ws(",", F.typeof("code"), F.typeof("number")).alias("kinds")
    return numbered(result, "code", "number", kinds)


@query
def timestamps_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id").select("event_id", "ts", ROW)
    return g.clean(df).repaired.select("event_id", "ts")


@query
def date_columns(spark, sf_dir):
    df = messy_orders(spark, sf_dir)
    names = ["status", "priority", "order_date", "amount", "urgent"]
    facts = metrics.date_shares(df, names)
    rows = [(n, f["filled"], f["date_like"], f["parsed"], f["is_date"]) for n, f in facts.items()]
    return spark.createDataFrame(rows, "column string, filled bigint, date_like bigint, parsed bigint, is_date boolean")


# Row checks


@query
def empty_rows(spark, sf_dir):
    return by_row(g.clean(messy_orders(spark, sf_dir)).empty)


@query
def missing_rows(spark, sf_dir):
    return by_row(g.clean(messy_orders(spark, sf_dir)).missing)


@query
def duplicate_rows(spark, sf_dir):
    return by_row(g.clean(messy_orders(spark, sf_dir)).duplicates)


@query
def conflicting_rows(spark, sf_dir):
    return by_row(g.clean(messy_orders(spark, sf_dir)).conflicts)


@query
def cleaned_rows(spark, sf_dir):
    cleaned = g.clean(messy_orders(spark, sf_dir)).cleaned
    return by_row(cleaned.withColumn("amount", F.round("amount", 4)))


@query
def clean_summary(spark, sf_dir):
    return g.clean(messy_orders(spark, sf_dir)).summary


@query
def duplicate_documents(spark, sf_dir):
    """Exact copies among whole document texts, casing and outer whitespace aside."""
    df = dealt_out(table(spark, sf_dir, "documents", "doc_id").select(ROW, "text", "lang"))
    return g.clean(df).duplicates.select("reason", F.md5("text").alias("digest"), F.col(ROW).alias("row_no"))


@query
def written_clean(spark, sf_dir):
    """Everything clean writes, counted after reading it back."""
    result = g.clean(messy_orders(spark, sf_dir))
    folder = scratch(spark)
    written = g.write_clean(result, folder)
    parts = [
        spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        for name, path in written.items()
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted


# Files


def _customer_csv(spark: SparkSession, sf_dir: str):
    path = scratch(spark)
    derived(spark, sf_dir, CUSTOMER_LINES).select("line").write.text(path)
    return g.read_csv(spark, path, names=CUSTOMER_FIELDS)


@query
def read_csv(spark, sf_dir):
    return _customer_csv(spark, sf_dir).df.drop(ROW)


@query
def csv_types(spark, sf_dir):
    df = _customer_csv(spark, sf_dir).df
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    kinds = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("kind")) for n, t in df.dtypes if n != ROW])
    return rows.select("rows", F.inline(kinds))


@query
def csv_malformed_lines(spark, sf_dir):
    return _customer_csv(spark, sf_dir).malformed.select("line")


@query
def csv_latin_text(spark, sf_dir):
    """Texts written in ISO-8859-1 come back whole, and the reader says how it read them."""
    path = scratch(spark)
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "body")
    lines = derived(spark, sf_dir, PLAIN_TEXTS).select(F.encode(line, "ISO-8859-1").cast("string").alias("line"))
    lines.write.text(path)
    read = g.read_csv(spark, path, names=["doc_id", "body"])
    noted = F.lit(read.encoding_note is not None).alias("noted")
    return read.df.select("doc_id", F.md5(text.strip(F.col("body"))).alias("digest"), noted)


@query
def write_formats(spark, sf_dir):
    """A cleaned table written in every format and read back."""
    cleaned = g.clean(table(spark, sf_dir, "customer", "c_custkey")).cleaned
    folder, parts = scratch(spark), []
    for fmt in ("csv", "json", "parquet"):
        path = g.write_table(cleaned, f"{folder}/customer.{fmt}")
        back = spark.read.option("header", True).format(fmt).load(path)
        balance = F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance")
        parts.append(back.agg(F.lit(fmt).alias("format"), F.count("c_name").alias("rows"), balance))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def read_json(spark, sf_dir):
    path = scratch(spark)
    df = table(spark, sf_dir, "supplier")
    df.select(F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal")).alias("v")).write.text(path)
    return g.read_json(spark, path, lines=True).drop(ROW)


@query
def gather_folder(spark, sf_dir):
    """Tables found in a folder, of different file types, joined on the key they share."""
    folder = scratch(spark)
    table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cust_id").drop(ROW).write.json(f"{folder}/customers.jsonl")
    table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "cust_id").drop(ROW).write.parquet(f"{folder}/orders.parquet")
    result = g.gather(g.read_tables(spark, [folder]))
    sums = (F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total"), F.max("c_acctbal").alias("balance"))
    counted = result.joined.groupBy("cust_id", "c_name", "c_mktsegment").agg(*sums)
    return counted.withColumn("join_key", F.lit(result.key))


@query
def id_columns(spark, sf_dir):
    """Columns whose names say they identify something, and how well they do over all rows."""
    parts = []
    for name in ("events", "documents", "labels", "pages", "embeddings", "benchmark", "conversations", "orders"):
        df = table(spark, sf_dir, name)
        for c in (c for c in df.columns if g.is_id_name(c)):
            counts = (F.count(c).alias("filled"), F.count_distinct(c).alias("distinct_values"))
            parts.append(df.agg(F.lit(name).alias("name"), F.lit(c).alias("column"), *counts))
    return reduce(DataFrame.unionByName, parts)


# Profile

PROFILED = {
    "orders": ("orders", "o_orderkey", ORDER_IDS),
    "lineitem": ("lineitem", "l_orderkey * 10 + l_linenumber", LINE_IDS),
    "customer": ("customer", "c_custkey", ["c_custkey"]),
    "events": ("events", "event_id", None),
    "documents": ("documents", "doc_id", None),
    "conversations": ("conversations", "conv_id * 1000 + turn", None),
}


def profiled(spark: SparkSession, sf_dir: str, name: str):
    source, order, ids = PROFILED[name]
    return g.profile(table(spark, sf_dir, source, order), ids)


def _profile_columns(name: str) -> None:
    def run(spark, sf_dir):
        return profiled(spark, sf_dir, name).columns

    run.__name__ = f"profile_{name}"
    query(run)


for _name in PROFILED:
    _profile_columns(_name)


@query
def profile_messy(spark, sf_dir):
    return g.profile(messy_orders(spark, sf_dir)).columns


@query
def profile_table(spark, sf_dir):
    return g.profile(messy_orders(spark, sf_dir)).table


@query
def top_values(spark, sf_dir):
    return profiled(spark, sf_dir, "customer").top_values


@query
def top_long_values(spark, sf_dir):
    found = profiled(spark, sf_dir, "documents").top_values
    return found.select("column", "rank", F.md5("value").alias("digest"), "n")


@query
def casing_examples(spark, sf_dir):
    return g.profile(messy_orders(spark, sf_dir)).casing_examples


@query
def duplicate_values(spark, sf_dir):
    return profiled(spark, sf_dir, "events").duplicate_values


@query
def duplicate_row_examples(spark, sf_dir):
    return by_row(g.profile(messy_orders(spark, sf_dir)).duplicate_row_examples)


# Analyze


@query
def correlations(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "lineitem"), LINE_IDS).correlations


@query
def correlations_with_gaps(spark, sf_dir):
    """Pairs use the rows where both values are present; a constant column has no correlation."""
    gaps = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    part = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 2 + F.col("o_custkey"))
    df = table(spark, sf_dir, "orders").select(
        gaps.alias("gaps"), part.alias("part"), F.col("o_custkey").alias("customer"), F.lit(3.5).alias("constant")
    )
    return g.analyze(df).correlations


@query
def group_candidates(spark, sf_dir):
    found = metrics.group_columns(table(spark, sf_dir, "events"), IdNames(None), listed=None)
    found += metrics.group_columns(table(spark, sf_dir, "orders"), IdNames(ORDER_IDS), listed=None)
    return spark.createDataFrame(found, "column string, distinct_values bigint, filled bigint")


@query
def group_comparisons(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "lineitem"), LINE_IDS).group_comparisons


@query
def group_comparisons_many(spark, sf_dir):
    """More groups than are listed: the best eight and the lowest."""
    df = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_retailprice", "p_size")
    return g.analyze(df).group_comparisons


@query
def date_span(spark, sf_dir):
    spans = []
    for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        span = metrics.date_span(metrics.daily(metrics.moments(table(spark, sf_dir, name), column), []))
        spans.append((name, span["rows"], span["days"], span["period"]))
    return spark.createDataFrame(spans, "name string, rows bigint, days bigint, period string")


@query
def trend_by_year(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "orders"), ORDER_IDS).trends


@query
def trend_by_week(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "events")).trends


@query
def trend_text_dates(spark, sf_dir):
    return g.analyze(derived(spark, sf_dir, DATED_ORDERS)).trends


@query
def period_averages(spark, sf_dir):
    measures = ["l_quantity", "l_extendedprice"]
    days = metrics.daily(metrics.moments(table(spark, sf_dir, "lineitem"), "l_shipdate"), measures)
    found = metrics.period_averages(days, measures, "month")
    return found.select(
        F.date_format("_gm_period", "yyyy-MM-dd").alias("period"),
        F.round("m0", 4).alias("quantity"),
        F.round("m1", 4).alias("price"),
    )


@query
def outliers(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "events")).outliers


@query
def outliers_of_lines(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "lineitem"), LINE_IDS).outliers


@query
def outlier_examples(spark, sf_dir):
    return g.analyze(table(spark, sf_dir, "events", "event_id")).outlier_examples


@query
def analyze_all(spark, sf_dir):
    """How many findings of each kind the orders give."""
    found = g.analyze(table(spark, sf_dir, "orders", "o_orderkey"), ORDER_IDS)
    parts = {
        "columns": found.profile.columns,
        "correlations": found.correlations,
        "trends": found.trends,
        "group_comparisons": found.group_comparisons,
        "outliers": found.outliers,
        "outlier_examples": found.outlier_examples,
    }
    counted = [df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("findings")) for n, df in parts.items()]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


# Gather


def _labelled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "documents": table(spark, sf_dir, "documents", "doc_id"),
        "labels": table(spark, sf_dir, "labels", "doc_id"),
    }


def _keyed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "orders": derived(spark, sf_dir, KEYED_ORDERS),
        "customers": derived(spark, sf_dir, KEYED_CUSTOMERS),
        "segments": derived(spark, sf_dir, KEYED_SEGMENTS),
    }


@query
def shared_overlap(spark, sf_dir):
    tables = list(_keyed(spark, sf_dir).values())
    found = overlap_scores(tables, shared_columns(tables))
    return found.select("column", F.round("score", 4).alias("score"))


@query
def text_overlap(spark, sf_dir):
    """Overlap of long texts, case and outer whitespace aside."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # Every third document has another id and text than in the first table.
    changed = F.col("doc_id") % 3 == 0
    body = F.when(changed, F.concat(F.lit("* "), "text")).otherwise(F.concat(F.lit(" "), loud(F.col("text"))))
    other = docs.select(F.when(changed, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), body.alias("TEXT"), "lang")
    found = overlap_scores([docs, other], shared_columns([docs, other]))
    return found.select("column", F.round("score", 4).alias("score"))


@query
def gather_summary(spark, sf_dir):
    return g.gather(_keyed(spark, sf_dir)).summary.select("mode", "join_column", "overlap_score", "final_row_count")


@query
def gather_two(spark, sf_dir):
    return g.gather(_labelled(spark, sf_dir)).joined


@query
def gather_three(spark, sf_dir):
    """Null keys meet null keys; clashing columns and spellings of the key are settled."""
    return g.gather(_keyed(spark, sf_dir)).joined


@query
def gather_fanout(spark, sf_dir):
    return g.gather(_keyed(spark, sf_dir)).fanout


@query
def gather_rows(spark, sf_dir):
    return g.gather(_keyed(spark, sf_dir)).rows_per_input


@query
def gather_apart(spark, sf_dir):
    """No shared column with shared values: the tables stay as they are."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("note"), "o_orderkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("Note"), "p_partkey")
    result = g.gather({"orders.csv": orders, "part.csv": parts})
    counted = [
        t.agg(F.lit(result.mode).alias("mode"), F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
        for n, t in result.tables.items()
    ]
    return counted[0].unionByName(counted[1])


# Lost digits, clashing names, files of several headers


@query
def whole_numbers_with_gaps(spark, sf_dir):
    """Whole numbers beyond 2^53 with gaps keep every digit, and no row is taken for a copy of another."""
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    big = F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_orderkey") + F.lit(9007199254740993)).cast("string"))
    result = g.clean(orders.select(big.alias("big"), F.col("o_orderkey").alias("order_no"), ROW))
    final = result.counts["final_row_count"]
    return numbered(result.repaired, "big").withColumn("final_rows", F.lit(final).cast("bigint"))


@query
def fill_decimals(spark, sf_dir):
    """The median of decimals keeps its fraction."""
    balance = F.when(F.col("c_custkey") % 10 != 3, F.col("c_acctbal").cast("decimal(12,2)").cast("decimal(12,0)"))
    customers = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", balance.alias("balance"), ROW)
    return numbered(g.clean(customers).filled, F.col("balance").cast("double").alias("balance"))


HELPER_NAMES = ["_id", "_key", "_before", "_k1", "_n", "_at", "_salt", "_best", "_first", "_day", "_m0"]


@query
def conflicts_with_helper_names(spark, sf_dir):
    """Columns named as helper columns might be are data like any other."""
    orders = table(spark, sf_dir, "orders")
    copies = F.explode(F.when(F.col("o_orderkey") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = orders.select("o_orderkey", copies.alias("copy"))
    cells = [F.concat(F.lit(f"{n} "), F.col("copy").cast("string")).alias(n) for n in HELPER_NAMES]
    df = rows.select(F.col("o_orderkey").alias("order_id"), *cells, (F.col("o_orderkey") * 10 + F.col("copy")).alias(ROW))
    found = g.clean(df).conflicts
    return numbered(found, "reason", "order_id", *HELPER_NAMES)


@query
def gather_mixed_keys(spark, sf_dir):
    """A whole number, a decimal and a double with gaps are one key where their values are equal."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust_id")).agg(F.count(F.lit(1)).alias("orders"))
    customers = table(spark, sf_dir, "customer")
    named = customers.select(F.col("c_custkey").cast("decimal(20,2)").alias("cust_id"), "c_name")
    gap = F.when(F.col("c_custkey") % 20 != 0, F.col("c_custkey").cast("double"))
    parts = customers.select(gap.alias("cust_id"), F.col("c_nationkey").alias("nation")).filter("cust_id is not null")
    joined = g.gather({"orders": orders, "customers": named, "nations": parts}).joined
    return joined.select(F.col("cust_id").cast("bigint").alias("cust_id"), "orders", "c_name", "nation")


@query
def gather_dates(spark, sf_dir):
    """A date and its midnight are one key."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day"))
    joined = g.gather({"orders": orders, "lines": lines.agg(F.count(F.lit(1)).alias("lines"))}).joined
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "orders", "lines")


@query
def gather_decimals(spark, sf_dir):
    """Decimals of different precision keep all digits: neighbours beyond 2^53 stay apart."""
    wide = F.lit("12345678901234567890").cast("decimal(20,0)")
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + wide).cast("decimal(22,0)").alias("item_id"), "o_totalprice")
    other = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0")
    other = other.select((F.col("o_orderkey") + wide).cast("decimal(24,2)").alias("item_id"), "o_orderstatus")
    joined = g.gather({"orders": orders, "status": other}).joined
    return joined.select((F.col("item_id") - wide).cast("bigint").alias("order_no"), "o_totalprice", "o_orderstatus")


def _with_headers(spark: SparkSession, sf_dir: str):
    """All customers in three files, each with a header of its own."""
    folder, customers = scratch(spark), table(spark, sf_dir, "customer")
    headers = (["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_custkey", "c_name"], ["c_name", "c_custkey"])
    paths = []
    for i, names in enumerate(headers):
        part = customers.filter(F.col("c_custkey") % 3 == i).select(*names)
        paths.append(f"{folder}/{i}.csv")
        part.write.csv(paths[-1], header=True)
    return g.read_csv(spark, paths)


@query
def csv_with_headers(spark, sf_dir):
    return _with_headers(spark, sf_dir).df.drop(ROW)


@query
def profile_csv(spark, sf_dir):
    """A CSV table goes to profile as it was read."""
    found = g.profile(_with_headers(spark, sf_dir))
    return found.columns.select("column", "dtype", "null_count", "unique_count")


@query
def csv_repeated_names(spark, sf_dir):
    """A name that occurs twice in the header is made distinct, and reported."""
    path = scratch(spark)
    customers = table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    # One file for each part of the customers, the header first.
    parts = customers.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(4)))
    headers = spark.range(4).select(F.lit("cust_no,label,label").alias("line"), F.col("id").alias("part"))
    rows = headers.withColumn("at", F.lit(0)).unionByName(parts.withColumn("at", F.lit(1)))
    rows.repartition(4, "part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    read = g.read_csv(spark, [f"{path}/part={i}" for i in range(4)])
    names = F.lit(",".join(read.duplicate_names)).alias("repeated")
    return read.df.select("cust_no", "label", F.col("`label.1`").alias("label_1"), names)


@query
def csv_malformed_places(spark, sf_dir):
    """File and line of the lines with too many fields."""
    path = scratch(spark)
    lines = derived(spark, sf_dir, CUSTOMER_LINES).select("k", "line", F.pmod("k", F.lit(4)).alias("part"))
    lines.repartition(4, "part").sortWithinPartitions("part", "k").drop("k").write.partitionBy("part").text(path)
    read = g.read_csv(spark, [f"{path}/part={i}" for i in range(4)], names=CUSTOMER_FIELDS)
    part = F.regexp_extract("file", r"part=(\d)", 1).cast("int").alias("part")
    return read.malformed.select(part, F.col("line_number").cast("bigint").alias("line_number"), "line")


@query
def csv_line_breaks(spark, sf_dir):
    """Whole documents as CSV: their line breaks are inside quotes, and many tasks read each file."""
    path = scratch(spark)
    documents = table(spark, sf_dir, "documents")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "quoteAll": True}
    documents.write.options(**kept).csv(path, header=True)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "1m"}):
        read = g.read_csv(spark, path, multi_line=True).df
        return read.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang", "source", "n_chars")


@query
def csv_record_numbers(spark, sf_dir):
    """File and number of the records with too many fields, where records span lines."""
    path = scratch(spark)
    record = F.expr("""concat(c_custkey, ',"', c_name, if(c_custkey % 3 = 0, '\n5"" pipe,\n', ' 5"" '), '",', c_mktsegment,
      if(c_custkey % 50 = 5, ',"one\nmore"', ''))""")
    records = table(spark, sf_dir, "customer").select("c_custkey", record.alias("line"), F.pmod("c_custkey", F.lit(4)).alias("part"))
    records.repartition(4, "part").sortWithinPartitions("part", "c_custkey").drop("c_custkey").write.partitionBy("part").text(path)
    read = g.read_csv(spark, [f"{path}/part={i}" for i in range(4)], names=["no", "name", "segment"], multi_line=True)
    part = F.regexp_extract("file", r"part=(\d)", 1).cast("int").alias("part")
    return read.malformed.select(part, F.col("line_number").cast("bigint").alias("record_number"), "line", F.lit(read.df.count()).cast("bigint").alias("rows"))


def write_array(records: DataFrame, path: str) -> None:
    """One file that holds one array of all records (column record): written in turn, each held on its own."""
    last = records.count() - 1
    placed = records.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    before = F.when(F.col("at") == 0, "[").otherwise(" ")
    after = F.when(F.col("at") == last, "]").otherwise(",")
    placed.select(F.concat(before, "record", after).alias("value")).write.text(path)


@query
def json_one_array(spark, sf_dir):
    """All orders as one array in one file, with braces in texts and nested records; many tasks read it."""
    path = scratch(spark)
    note = F.concat(F.lit('}{"'), "o_orderpriority", F.lit("]\\"))
    nested = F.struct(F.col("o_custkey").alias("no"), F.array(F.struct(F.col("o_orderstatus").alias("status"), note.alias("note"))).alias("notes"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", nested.alias("customer"))
    write_array(orders.select(F.to_json(F.struct(*orders.columns)).alias("record")), path)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "1m"}):
        read = g.read_json(spark, path)
        first = F.get("customer.notes", F.lit(0))
        return read.select("o_orderkey", "o_totalprice", "customer.no", first["status"].alias("status"), first["note"].alias("note"))


@query
def csv_no_rows(spark, sf_dir):
    """Files with nothing but the header of a table: no rows, all columns, and every operation says so."""
    path = scratch(spark)
    customers = table(spark, sf_dir, "customer")
    spark.createDataFrame([(",".join(customers.columns),)], "line string").coalesce(1).write.text(path)
    read = g.read_csv(spark, path)
    cleaned, profiled_ = g.clean(read), g.profile(read)
    counts = cleaned.cleaned.agg(F.count(F.lit(1)).alias("rows"))
    warned = F.lit(bool(cleaned.warning and profiled_.warning)).alias("warned")
    return counts.select("rows", F.lit(",".join(c for c in read.df.columns if c != ROW)).alias("names"), warned, F.lit(profiled_.row_count).cast("bigint").alias("profiled"))


@query
def first_seen_over_files(spark, sf_dir):
    """The first of several files is the smallest; its spelling is the first seen all the same."""
    folder, customers = scratch(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    few = F.col("c_custkey") % 10 == 0
    customers.filter(few).withColumn("c_name", F.lower("c_name")).coalesce(1).write.csv(f"{folder}/a.csv", header=True)
    customers.write.csv(f"{folder}/b.csv", header=True)
    repaired = g.clean(g.read_csv(spark, [f"{folder}/a.csv", f"{folder}/b.csv"]), ["c_custkey"]).repaired
    return repaired.select("c_custkey", "c_name")


@query
def read_json_array(spark, sf_dir):
    """Files that hold an array of records each; columns come in the order of the first record."""
    path = scratch(spark)
    record = F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal", "s_nationkey")).alias("record")
    suppliers = table(spark, sf_dir, "supplier")
    for i in range(8):
        write_array(suppliers.filter(F.pmod("s_suppkey", F.lit(8)) == i).select(record), f"{path}/part={i}")
    read = g.read_json(spark, [f"{path}/part={i}" for i in range(8)])
    names = F.lit(",".join(c for c in read.columns if c != ROW)).alias("names")
    return read.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey", names)


@query
def correlations_many(spark, sf_dir):
    """More pairs than are listed."""
    lines = table(spark, sf_dir, "lineitem")
    more = {
        "charge": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "unit": F.col("l_extendedprice") / F.col("l_quantity"),
        "half": F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity") + F.col("l_tax")),
        "squared": F.col("l_quantity") * F.col("l_quantity"),
        "rest": F.col("l_quantity") - F.col("l_linenumber"),
        "price_tax": F.col("l_extendedprice") * F.col("l_tax"),
    }
    return g.analyze(lines.withColumns(more), LINE_IDS).correlations


@query
def written_gather(spark, sf_dir):
    """What gather writes, counted after reading it back."""
    written = g.write_gather(g.gather(_keyed(spark, sf_dir)), scratch(spark))
    parts = [
        spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        for name, path in written.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def gather_ordered(spark, sf_dir):
    """The places at which the rows of each key stand in the files that gather writes in key order."""
    result = g.gather(_keyed(spark, sf_dir))
    written = g.write_gather(result, scratch(spark), ordered=True)
    read = g.read_parquet(spark, written["gathered"])
    places = number_rows(read, [ROW], "place").groupBy("cust_id")
    counted = places.agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("null_key_rows", F.lit(result.summary.first()["null_key_rows"]).cast("bigint"))


@query
def gather_many_keys(spark, sf_dir):
    """Forty shared columns, of which few can be the key: only those are counted exactly."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    first = orders.select(*[key.alias(f"k{j}") for j in range(40)], "o_totalprice")
    second = orders.select(*[F.when(key % (abs(j - 7) + 1) == 0, key).otherwise(-key).alias(f"k{j}") for j in range(40)], "o_orderstatus")
    tables = [first, second]
    counted = len(possible_keys(tables, shared_columns(tables)))
    chosen, score = choose_key(tables)
    rows = g.gather({"first": first, "second": second}).joined.agg(F.count(F.lit(1)).alias("rows"), F.count("o_orderstatus").alias("met"))
    return rows.select("rows", "met", F.lit(chosen).alias("join_key"), F.lit(score).alias("score"), F.lit(counted <= 3).alias("few_counted"))


@query
def gather_file_notes(spark, sf_dir):
    """What was noticed while CSV inputs were read, of inputs with something to tell."""
    customers = _customer_csv(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust_no"), "o_totalprice")
    notes = g.gather({"customers.csv": customers, "orders": orders}).file_notes
    return notes.select("name", "malformed_rows_skipped", "encoding_note")
