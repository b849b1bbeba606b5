"""Correlations, trends, group comparisons and outliers of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import (
    CORRELATIONS_LISTED,
    DATE_LIKE_SHARE,
    GROUP_COLUMNS_LISTED,
    GROUP_MAX_DISTINCT,
    GROUP_MAX_DISTINCT_SHARE,
    GROUP_MIN_DISTINCT,
    GROUPS_LISTED,
    MODERATE_CORRELATION,
    OUTLIER_EXAMPLES,
    OUTLIER_FENCE,
    OUTLIER_MIN_ROWS,
    PERIODS,
    STRONG_CORRELATION,
)
from gristmill.naming import ROW, IdNames, col, data_columns, is_number, is_text, is_time, metric_columns
from gristmill.operators.cells import COLUMN, cells
from gristmill.operators.columns import as_double, values_of
from gristmill.operators.date_texts import DateTexts, date_facts
from gristmill.operators.quantiles import exact_quantiles
from gristmill.operators.rules import is_date_text
from gristmill.operators.store import keep

# Pairs per aggregate, to keep generated code small.
_PAIRS_AT_ONCE = 50

# Sketched distinct counts above this are surely above GROUP_MAX_DISTINCT.
_SURELY_MANY = 10 * GROUP_MAX_DISTINCT


def numbered_names(names: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)


def correlations(df: DataFrame, ids: IdNames, listed: int | None = CORRELATIONS_LISTED) -> DataFrame:
    """(column_a, column_b, correlation, strength) of the most correlated pairs of metrics.

    Each pair uses the rows where both values are present. One scan: each row gives its pairs of values, and
    each task combines them to one row per pair. A pair with a constant column has no correlation and is left out.
    """
    names = metric_columns(df, ids)
    work = df.select(*[as_double(df, n).alias(f"m{i}") for i, n in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    if len(pairs) <= _PAIRS_AT_ONCE:
        row = work.agg(*[_pearson(f"m{i}", f"m{j}").alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else ()
        found = [(i, j, names[i], names[j], r) for (i, j), r in zip(pairs, row) if r is not None]
    else:
        found = [(i, j, names[i], names[j], r) for i, j, r in _all_pairs(work) if r is not None]
    table = df.sparkSession.createDataFrame(found, "i int, j int, column_a string, column_b string, r double")
    ordered = table.select(
        "column_a",
        "column_b",
        F.round("r", 4).alias("correlation"),
        strength(F.col("r")).alias("strength"),
        "i",
        "j",
    ).orderBy(F.abs("correlation").desc(), "i", "j")
    return (ordered.limit(listed) if listed else ordered).drop("i", "j")


def _all_pairs(work: DataFrame) -> list[tuple[int, int, float | None]]:
    """The correlation of every two columns, without an expression per pair.

    Values are exploded with those behind them, as (i, j, x, y) where both are there.
    """
    values = F.array(*[F.col(c) for c in work.columns])
    first = work.select(values.alias("v")).select("v", F.posexplode("v").alias("i", "x")).filter("x is not null and i + 1 < size(v)")
    rest = F.slice("v", F.col("i") + 2, F.size("v"))
    both = first.select("i", "x", F.posexplode(rest).alias("k", "y")).filter("y is not null")
    per_pair = both.groupBy("i", (F.col("i") + F.col("k") + 1).alias("j"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return [tuple(row) for row in per_pair.agg(r.alias("r")).collect()]


def _pearson(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def strength(r: Column) -> Column:
    size = F.abs(r)
    label = F.when(size >= STRONG_CORRELATION, "strong").when(size >= MODERATE_CORRELATION, "moderate").otherwise("weak")
    return F.concat_ws(" ", label, F.when(r >= 0, "positive").otherwise("negative"))


class Dates:
    """The date columns of a table: typed ones, and text columns that look like and mostly parse as dates.

    Markers count as text here. One scan tells which text columns look like dates; only their distinct texts are parsed.
    """

    def __init__(self, df: DataFrame):
        types = {f.name: f.dataType for f in df.schema.fields}
        names = data_columns(df)
        self.facts = _looks(df, [n for n in names if is_text(types[n])])
        likely = {n: col(n) for n, f in self.facts.items() if f["filled"] and f["date_like"] / f["filled"] >= DATE_LIKE_SHARE}
        self.texts = DateTexts(df, likely, self.facts) if likely else None
        for n, f in self.facts.items():
            f["parsed"] = self.texts.counts(n)["parsed"] if n in likely else None
            f["is_date"] = n in likely and is_date_text(f["filled"], f["date_like"], f["parsed"])
        self.columns = [n for n in names if is_time(types[n]) or (n in self.facts and self.facts[n]["is_date"])]


def date_columns(df: DataFrame) -> list[str]:
    """Typed date columns, and text columns that look like and mostly parse as dates."""
    return Dates(df).columns


def date_shares(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """Per text column: filled cells, cells that look like a date, cells that parse as one where enough look so."""
    return Dates(df.select(*[col(n) for n in names])).facts if names else {}


def _looks(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    facts = {n: {"filled": 0, "date_like": 0, "date_kinds": 0, "other_bytes": 0} for n in names}
    if not names:
        return facts
    value = F.col("value")
    long = cells(df, [[col(n)] for n in names], ["value"]).filter(value.isNotNull())
    found = {k: e.alias(k) for k, e in {"filled": F.count(value), **date_facts(value, F.lit(True))}.items()}
    for r in long.groupBy(COLUMN).agg(*found.values()).collect():
        facts[names[r[COLUMN]]] = {k: r[k] for k in found}
    return facts


def moments(df: DataFrame, date_column: str, texts: DateTexts | None = None) -> DataFrame:
    """The table with the moment of each row in ``_gm_at``; texts are those of Dates, if known."""
    field = next(f for f in df.schema.fields if f.name == date_column)
    if is_time(field.dataType):
        return df.withColumn("_gm_at", col(date_column).cast("timestamp_ntz"))
    if texts is None:
        facts = _looks(df, [date_column])
        texts = DateTexts(df, {date_column: col(date_column)}, facts)
    return texts.with_moment(df, date_column, "_gm_at")


def daily(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per day: rows, first and last moment, and sum and count of every metric.

    One scan of the table; a calendar has few days, so all that follows is small.
    """
    values = [as_double(df, n) for n in metrics]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)]
    counts = [F.count(v).alias(f"c{i}") for i, v in enumerate(values)]
    days = df.filter(F.col("_gm_at").isNotNull()).groupBy(F.col("_gm_at").cast("date").alias("_gm_day"))
    return keep(
        days.agg(F.count(F.lit(1)).alias("rows"), F.min("_gm_at").alias("start"), F.max("_gm_at").alias("end"), *sums, *counts)
    )


def date_span(days: DataFrame) -> dict | None:
    """First and last moment, valid rows and the period fit for the span; None below two rows."""
    row = days.agg(F.sum("rows").alias("rows"), F.min("start").alias("start"), F.max("end").alias("end")).first()
    if not row["rows"] or row["rows"] < 2:
        return None
    length = (row["end"] - row["start"]).days
    period = next(label for least, label in PERIODS if length >= least)
    return {"rows": row["rows"], "start": row["start"], "end": row["end"], "days": length, "period": period}


def period_averages(days: DataFrame, metrics: Sequence[str], period: str) -> DataFrame:
    """(_period, m0, m1, ...): the mean of every metric per day, week, month or year."""
    start = F.date_trunc(period, F.col("_gm_day").cast("timestamp_ntz")).alias("_gm_period")
    means = [F.try_divide(F.sum(f"s{i}"), F.sum(f"c{i}")).alias(f"m{i}") for i in range(len(metrics))]
    return days.groupBy(start).agg(*means)


TREND_SCHEMA = (
    "column string, date_column string, period string, period_count bigint, start string, end string, "
    "first_period_average double, last_period_average double, percent_change double, direction string"
)


def trends(df: DataFrame, ids: IdNames, found: Dates | None = None) -> DataFrame:
    """One row per metric: its average in the first and in the last period of the first date column."""
    spark = df.sparkSession
    none = spark.createDataFrame([], TREND_SCHEMA)
    metrics = metric_columns(df, ids)
    if not metrics:
        return none
    found = found or Dates(df)
    dated = found.columns
    if not dated:
        return none
    days = daily(moments(df, dated[0], found.texts), metrics)
    span = date_span(days)
    if span is None:
        return none
    averages = period_averages(days, metrics, span["period"])
    ends = averages.agg(
        F.count(F.lit(1)).alias("period_count"),
        F.array(*[F.min_by(f"m{i}", "_gm_period") for i in range(len(metrics))]).alias("first"),
        F.array(*[F.max_by(f"m{i}", "_gm_period") for i in range(len(metrics))]).alias("last"),
    ).filter("period_count >= 2")
    ends = ends.select("period_count", F.posexplode(F.arrays_zip("first", "last")).alias("_gm_i", "_gm_ends"))
    first, last = F.col("_gm_ends.first"), F.col("_gm_ends.last")
    change = F.when(first != 0, F.round(F.try_divide(last - first, F.abs(first)) * 100, 2))
    direction = F.when(last > first, "increasing").when(last < first, "decreasing").otherwise("flat")
    return ends.filter(first.isNotNull() & last.isNotNull()).select(
        numbered_names(metrics, F.col("_gm_i")).alias("column"),
        F.lit(dated[0]).alias("date_column"),
        F.lit(span["period"]).alias("period"),
        "period_count",
        F.lit(span["start"].strftime("%Y-%m-%d")).alias("start"),
        F.lit(span["end"].strftime("%Y-%m-%d")).alias("end"),
        F.round(first, 4).alias("first_period_average"),
        F.round(last, 4).alias("last_period_average"),
        change.alias("percent_change"),
        direction.alias("direction"),
    )


def group_columns(df: DataFrame, ids: IdNames, listed: int | None = GROUP_COLUMNS_LISTED) -> list[tuple[str, int, int]]:
    """(column, distinct, filled) of columns fit for grouping, fewest distinct values first.

    A sketch rules out columns with far too many values; exact counts settle the others,
    so only columns with few values are ever shuffled.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in data_columns(df) if n not in ids and not is_number(types[n])]
    if not names:
        return []
    sketch = df.agg(*[F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(names)]).first()
    few = [n for n, d in zip(names, sketch) if d <= _SURELY_MANY]
    if not few:
        return []
    long = cells(df, [[v] for v in values_of(df, few).values()], ["value"]).filter("value is not null")
    counted = long.groupBy(COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))
    exact = counted.groupBy(COLUMN).agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("filled")).collect()
    fit = [
        (few[r[COLUMN]], r["distinct"], r["filled"])
        for r in sorted(exact, key=lambda r: r[COLUMN])
        if GROUP_MIN_DISTINCT <= r["distinct"] <= GROUP_MAX_DISTINCT
        and r["distinct"] / r["filled"] <= GROUP_MAX_DISTINCT_SHARE
    ]
    return sorted(fit, key=lambda f: f[1])[:listed]


def group_averages(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(_group_by, _metric, group, average): the mean of every metric per group of every column.

    All grouping columns share one scan and one map-side combined aggregate.
    """
    work = df.withColumns({f"_gm_m{i}": as_double(df, n) for i, n in enumerate(metrics)})
    kept = [f"_gm_m{i}" for i in range(len(metrics))]
    long = cells(work, [[v] for v in values_of(df, groups).values()], ["group"], carried=kept)
    averages = long.filter("group is not null").groupBy(COLUMN, "group").agg(*[F.avg(m).alias(m) for m in kept])
    stacked = F.stack(F.lit(len(kept)), *[x for i, m in enumerate(kept) for x in (F.lit(i), F.col(m))])
    return (
        averages.select(F.col(COLUMN).alias("_gm_group_by"), "group", stacked.alias("_gm_metric", "average"))
        .filter("average is not null")
    )


def group_comparisons(df: DataFrame, ids: IdNames) -> DataFrame:
    """(group_by, metric, rank, group, average, is_highest, is_lowest): groups compared by average.

    Per grouping column and metric the best groups, and always the highest and the lowest.
    """
    metrics = metric_columns(df, ids)
    groups = [g[0] for g in group_columns(df, ids)] if metrics else []
    schema = "group_by string, metric string, rank bigint, `group` string, average double, is_highest boolean, is_lowest boolean"
    if not groups:
        return df.sparkSession.createDataFrame([], schema)
    pair = Window.partitionBy("_gm_group_by", "_gm_metric")
    ranked = (
        group_averages(df, groups, metrics)
        .withColumn("rank", F.row_number().over(pair.orderBy(F.desc("average"), "group")).cast("bigint"))
        .withColumn("groups", F.count(F.lit(1)).over(pair))
        .filter((F.col("groups") >= 2) & ((F.col("rank") <= GROUPS_LISTED) | (F.col("rank") == F.col("groups"))))
    )
    return ranked.select(
        numbered_names(groups, F.col("_gm_group_by")).alias("group_by"),
        numbered_names(metrics, F.col("_gm_metric")).alias("metric"),
        "rank",
        "group",
        F.round("average", 4).alias("average"),
        (F.col("rank") == 1).alias("is_highest"),
        (F.col("rank") == F.col("groups")).alias("is_lowest"),
    )


class Outliers:
    """Values beyond 1.5 interquartile ranges from the quartiles, per metric."""

    def __init__(self, df: DataFrame, ids: IdNames):
        self._df = df
        metrics = metric_columns(df, ids)
        self._values = {n: as_double(df, n) for n in metrics}
        self._filled = {}
        if metrics:
            row = df.agg(*[F.count(v).alias(f"c{i}") for i, v in enumerate(self._values.values())]).first()
            self._filled = {n: c for n, c in zip(metrics, row) if c >= OUTLIER_MIN_ROWS}
        enough = {n: self._values[n] for n in self._filled}
        quartiles = exact_quantiles(df, enough, [0.25, 0.75], self._filled)
        self.bounds = {}
        for name, found in quartiles.items():
            if found and found[0] != found[1]:
                fence = OUTLIER_FENCE * (found[1] - found[0])
                self.bounds[name] = (found[0] - fence, found[1] + fence)

    def _outside(self, name: str, value: Column) -> Column:
        low, high = self.bounds[name]
        return (value < F.lit(low)) | (value > F.lit(high))

    def table(self) -> DataFrame:
        """(column, outlier_count, outlier_percent, lower_bound, upper_bound)."""
        schema = "column string, outlier_count bigint, outlier_percent double, lower_bound double, upper_bound double"
        records = []
        if self.bounds:
            tests = [F.count_if(self._outside(n, self._values[n])).alias(f"o{i}") for i, n in enumerate(self.bounds)]
            for (n, (low, high)), outside in zip(self.bounds.items(), self._df.agg(*tests).first()):
                if outside:
                    records.append((n, outside, outside / self._filled[n] * 100, low, high))
        return self._df.sparkSession.createDataFrame(records, schema).select(
            "column",
            "outlier_count",
            F.round("outlier_percent", 2).alias("outlier_percent"),
            F.round("lower_bound", 4).alias("lower_bound"),
            F.round("upper_bound", 4).alias("upper_bound"),
        )

    def examples(self) -> DataFrame:
        """(column, rank, value): the first outliers in row order."""
        if not self.bounds:
            return self._df.sparkSession.createDataFrame([], "column string, rank bigint, value double")
        names = list(self.bounds)
        rows = [[F.when(self._outside(n, self._values[n]), self._values[n])] for n in names]
        outside = cells(self._df, rows, ["value"], carried=[ROW]).filter("value is not null")
        order = Window.partitionBy(COLUMN).orderBy(ROW, "value")
        first = outside.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= OUTLIER_EXAMPLES)
        return first.select(
            numbered_names(names, F.col(COLUMN)).alias("column"),
            F.col("rank").cast("bigint").alias("rank"),
            F.round("value", 4).alias("value"),
        )
