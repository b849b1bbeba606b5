"""Exact quantiles, however many values and columns there are: two passes over the table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.cells import COLUMN, cells
from gristmill.operators.order import POSITION_BITS
from gristmill.operators.store import keep

# Up to this many values percentile() is used: it holds a map of all distinct values in one task.
SMALL_ROWS = 1_000_000
# Values of all columns held in one task at once; columnar files are read once all the same.
_VALUES_AT_ONCE = 5_000_000
# Size of a sketch, and the share of ranks by which it may be off; a miss costs one more pass, no digit.
_SKETCH = 4_096
_MARGIN = 0.004


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    small_rows: int | None = None,
    margin: float = _MARGIN,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values.

    ``counts`` gives the number of values per column if the caller knows it already. ``margin`` is the share of ranks
    on both sides of a wanted one whose values the second pass looks at.
    """
    if not values:
        return {}
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    work = df.select(*[v.cast("double").alias(f"q{i}") for i, v in enumerate(values.values())])
    columns = work.columns
    if counts is None:
        counts = work.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    else:
        counts = {c: counts[name] for name, c in zip(values, columns)}
    if max(counts.values()) <= small_rows:
        probs = F.array(*[F.lit(p) for p in probabilities])
        found = {}
        for block in _blocks(columns, counts, _VALUES_AT_ONCE):
            row = work.agg(*[F.percentile(c, probs).alias(c) for c in block]).first()
            found.update({c: row[c] for c in block})
    else:
        ranks = {
            (c, r): None
            for c in columns
            for p in probabilities
            if counts[c]
            for r in {math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1))}
        }
        values_at = _values_at(work, list(ranks), counts, margin)
        found = {c: _interpolate(c, counts[c], probabilities, values_at) for c in columns}
    return {name: found[c] for name, c in zip(values, columns)}


def _blocks(columns: Sequence[str], sizes: Mapping[str, int], limit: int) -> list[list[str]]:
    """Columns in blocks whose sizes add up to a limit at most; a column of its own may exceed it."""
    blocks: list[list[str]] = []
    room = -1
    for c in columns:
        if room < sizes[c]:
            blocks.append([])
            room = limit
        blocks[-1].append(c)
        room -= sizes[c]
    return blocks


def _interpolate(c: str, n: int, probabilities: Sequence[float], values_at: dict) -> list[float] | None:
    if n == 0:
        return None
    result = []
    for p in probabilities:
        at = p * (n - 1)
        below, above = math.floor(at), math.ceil(at)
        low, high = float(values_at[c, below]), float(values_at[c, above])
        # The terms and their order are those of percentile(), so both ways agree in the last digit.
        result.append((above - at) * low + (at - below) * high if low != high else low)
    return result


def _values_at(work: DataFrame, ranks: list, counts: dict, margin: float) -> dict:
    """The value at each (column, rank).

    Mergeable sketches of all columns propose two bounds around each rank. One exact pass counts the values between all
    bounds and keeps those around the ranks, counted by value; the ranks are then found among the few that were kept.
    The outcome does not depend on how good a sketch is: a rank outside its bounds is looked for once more, between the
    bounds that the counts then name.
    """
    columns = work.columns
    asked: dict[str, list] = {}
    for c, rank in ranks:
        share = rank / counts[c]
        asked.setdefault(c, []).extend([max(0.0, share - margin), min(1.0, share + margin)])
    sketched = work.agg(*[F.kll_sketch_agg_double(c, F.lit(_SKETCH)).alias(c) for c in asked])
    row = sketched.select(*[F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c, qs in asked.items()]).first()
    bounds = {c: sorted(set(row[c])) for c in asked}
    # Intervals whose values are kept: those between the two bounds of a rank.
    wanted = {c: set() for c in asked}
    for c in asked:
        for low, high in zip(row[c][::2], row[c][1::2]):
            wanted[c].update(range(2 * bounds[c].index(low) + 2, 2 * bounds[c].index(high) + 1, 2))
    found: dict = {}
    left = list(ranks)
    while left:
        table = keep(_between(work, bounds, wanted))
        totals: dict[str, dict[int, int]] = {c: {} for c in asked}
        for r in table.groupBy(COLUMN, "place").agg(F.sum("n").alias("n")).collect():
            totals[columns[r[COLUMN]]][r["place"]] = r["n"]
        inside, missed = {}, []
        for c, rank in left:
            before = 0
            for place, n in sorted(totals[c].items()):
                if rank < before + n:
                    break
                before += n
            if place % 2:  # a bound itself
                found[c, rank] = bounds[c][place // 2]
            elif place in wanted[c]:
                inside[c, rank] = (place, rank - before)
            else:
                missed.append((c, rank, place))
        found |= _within(table, columns, inside)
        left = [(c, rank) for c, rank, _ in missed]
        wanted = {c: {place for m, _, place in missed if m == c} for c in asked}
    return found


def _between(work: DataFrame, bounds: dict[str, list], wanted: dict[str, set]) -> DataFrame:
    """(column, place, value, n): counted values by their place among a column's bounds b0 < b1 < ...

    Values equal to bk have place 2k + 1, those between it and the next place 2k + 2. Only wanted places keep values.
    """
    rows, numbers = [], []
    for c, own in bounds.items():
        place = F.when(F.col(c).isNotNull(), _place(F.col(c), own))
        rows.append([place, F.when(place.isin(sorted(wanted[c])), F.col(c))])
        numbers.append(work.columns.index(c))
    long = cells(work, rows, ["place", "value"], numbers=numbers).filter("place is not null")
    return long.groupBy(COLUMN, "place", "value").agg(F.count(F.lit(1)).alias("n"))


def _place(value: Column, bounds: list) -> Column:
    def passed(k: Column, bound: Column) -> Column:
        return k + (value >= bound).cast("int") + (value > bound).cast("int")

    return F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0), passed)


def _within(table: DataFrame, columns: Sequence[str], inside: dict) -> dict:
    """The values at places of wanted intervals: {(column, rank): (place, values of the interval before it)}.

    Values are ranged and sorted; the driver sees one sum per range and interval, and one row per rank.
    """
    if not inside:
        return {}
    spark = table.sparkSession
    keys = [COLUMN, "place", "value"]
    sought = {(columns.index(c), place) for (c, _), (place, _) in inside.items()}
    sought = F.broadcast(spark.createDataFrame(sorted(sought), f"{COLUMN} int, place int"))
    ranged = table.join(sought, [COLUMN, "place"]).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "n")
    placed = keep(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", POSITION_BITS).alias("part")
    sums = placed.groupBy(COLUMN, "place", part).agg(F.sum("n").alias("n")).orderBy(COLUMN, "place", "part").collect()
    targets = []
    for (c, rank), (place, offset) in inside.items():
        for r in sums:
            if (r[COLUMN], r["place"]) == (columns.index(c), place):
                if offset < r["n"]:
                    targets.append((r[COLUMN], place, r["part"], offset, rank))
                    break
                offset -= r["n"]
    wanted = F.broadcast(spark.createDataFrame(targets, f"{COLUMN} int, place int, part bigint, offset bigint, rank bigint"))
    upto = F.sum("n").over(Window.partitionBy(COLUMN, "place", "part").orderBy("at"))
    running = placed.withColumn("part", part).withColumn("upto", upto)
    hit = running.join(wanted, [COLUMN, "place", "part"]).filter((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
    return {(columns[r[COLUMN]], r["rank"]): r["value"] for r in hit.select(COLUMN, "rank", "value").collect()}
