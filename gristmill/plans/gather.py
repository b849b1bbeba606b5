"""Combine tables on a key chosen by how far its values really overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.constants import MIN_KEY_OVERLAP, STEM_LENGTH
from gristmill.functions import numbers, text
from gristmill.functions.keys import KEY, row_key
from gristmill.naming import col, data_columns, match_name
from gristmill.operators.cells import COLUMN, cells
from gristmill.operators.full_join import FullJoin
from gristmill.operators.order import ensure_row_order
from gristmill.sources.csv import CsvTable, file_notes

KEPT_APART = (
    "No column with enough matching values was found in all tables, "
    "so the tables were kept apart instead of being joined on a doubtful key."
)

# Up to this many shared columns are all counted exactly. Sketches hold 2 to this power values; each table's is held
# against the others', so they are for a few tables.
COUNTED_AT_ONCE = 3
SKETCH_BITS = 14
SKETCHED_TABLES = 8

# Tables that share a whole number, one bit each.
_BITS = 62


def stem(name: str) -> str:
    """A table or file name without its extension."""
    return name.rsplit(".", 1)[0]


def column_named(df: DataFrame, name: str) -> str | None:
    """The first column whose name matches, upper and lower case and outer spaces aside."""
    return next((n for n in data_columns(df) if match_name(n) == match_name(name)), None)


def shared_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns every table has, spelled and ordered as in the first table."""
    if not tables:
        return []
    others = [{match_name(n) for n in data_columns(t)} for t in tables[1:]]
    return [n for n in data_columns(tables[0]) if all(match_name(n) in names for names in others)]


def _join_text(df: DataFrame, name: str) -> Column:
    """A key value as compared for overlap: text, trimmed, lower-cased."""
    kind = dict(df.dtypes)[name]
    return F.lower(text.strip(text.key_text(numbers.no_nan(col(name), kind), kind)))


def overlap_scores(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(column, score): the mean share of each table's distinct values found in any other table.

    All candidate columns take part in one pass. A distinct value travels as two hashes and a
    bit per table it occurs in, combined on the map side, so neither long texts nor frequent
    values weigh on the shuffle.
    """
    words = range(-(-len(tables) // _BITS))

    def bits(number: int) -> list[Column]:
        """Whole numbers with the one bit set that stands for a table."""
        return [F.lit(1 << number % _BITS if w == number // _BITS else 0).cast("bigint") for w in words]

    parts = []
    for number, table in enumerate(tables):
        names = [column_named(table, c) for c in columns]
        long = cells(table, [[_join_text(table, n)] for n in names], ["value"]).filter(F.col("value").isNotNull())
        long = long.select(COLUMN, *[k.alias(n) for n, k in row_key([F.col("value")]).items()])
        parts.append(long.withColumns({f"_gm_in{w}": bit for w, bit in zip(words, bits(number))}))
    found_in = [F.bit_or(f"_gm_in{w}").alias(f"_gm_in{w}") for w in words]
    values = reduce(DataFrame.unionByName, parts).groupBy(COLUMN, *KEY).agg(*found_in)
    tests = []
    for number in range(len(tables)):
        own = bits(number)
        here = F.col(f"_gm_in{number // _BITS}").bitwiseAND(own[number // _BITS]) != 0
        elsewhere = reduce(lambda x, y: x | y, [F.col(f"_gm_in{w}") != own[w] for w in words])
        tests += [F.count_if(here).alias(f"all{number}"), F.count_if(here & elsewhere).alias(f"met{number}")]
    tallied = values.groupBy(COLUMN).agg(*tests)
    shares = [F.try_divide(F.col(f"met{i}"), F.col(f"all{i}")) for i in range(len(tables))]
    # A table without any value leaves its share, and with it the sum, null: no overlap.
    score = F.coalesce(reduce(lambda a, b: a + b, shares) / len(tables), F.lit(0.0))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(COLUMN) + 1)
    return tallied.select(named.alias("column"), score.alias("score"))


def possible_keys(tables: Sequence[DataFrame], columns: Sequence[str]) -> list[str]:
    """The columns whose overlap can be the best or tie with it, by sketches of their distinct values.

    Each table is read once, whatever the number of columns, and nothing but sketches of fixed size is shuffled. A
    sketch that holds all distinct values is exact; else its estimates are off by three standard errors at most, but
    for one case in some hundred, so columns further behind are out.
    """
    sketched = []
    for number, table in enumerate(tables):
        names = [column_named(table, c) for c in columns]
        row = table.agg(*[F.theta_sketch_agg(_join_text(table, n), F.lit(SKETCH_BITS)).alias(f"s{i}") for i, n in enumerate(names)])
        each = [x for i in range(len(columns)) for x in (F.lit(i), F.col(f"s{i}"))]
        sketched.append(row.select(F.stack(F.lit(len(columns)), *each).alias(COLUMN, f"t{number}")))
    every = reduce(lambda a, b: a.join(b, COLUMN), sketched)
    own = [F.col(f"t{i}") for i in range(len(tables))]
    shares, sizes = [], []
    for i, sketch in enumerate(own):
        others = reduce(F.theta_union, [o for j, o in enumerate(own) if j != i])
        size = F.theta_sketch_estimate(sketch)
        shares.append(F.coalesce(F.try_divide(F.theta_sketch_estimate(F.theta_intersection(sketch, others)), size), F.lit(0.0)))
        sizes.append(size)
    score = reduce(lambda a, b: a + b, shares) / len(tables)
    exact = F.greatest(*sizes) < (1 << SKETCH_BITS) // 2
    error = F.when(exact, 1e-9).otherwise(3 * 2 ** (1 - SKETCH_BITS / 2))
    rows = sorted(every.select(COLUMN, score.alias("score"), error.alias("error")).collect())
    least = max((r["score"] - r["error"] for r in rows), default=0.0)
    return [columns[r[COLUMN]] for r in rows if r["score"] + r["error"] >= least]


def choose_key(tables: Sequence[DataFrame], min_overlap: float = MIN_KEY_OVERLAP) -> tuple[str | None, float]:
    """The shared column with the best overlap, first column first on a tie; None below the minimum.

    Of many columns only those are counted exactly that can be the best.
    """
    candidates = shared_columns(tables)
    if not candidates:
        return None, 0.0
    if len(candidates) > COUNTED_AT_ONCE and len(tables) <= SKETCHED_TABLES:
        candidates = possible_keys(tables, candidates)
    scores = dict(overlap_scores(tables, candidates).collect())
    best = max(candidates, key=lambda c: scores.get(c, 0.0))
    score = scores.get(best, 0.0)
    return (best, score) if score > 0 and score >= min_overlap else (None, score)


class GatherResult:
    """Tables joined on one key (``mode`` "joined"), or kept apart (``mode`` "apart").

    ``joined`` is the combined table or None; ``tables`` the separate ones by name or None.
    ``joined_in_order`` has the same rows in the order of their keys. ``fanout`` has one (step, name, rows) row per join,
    known before any join runs.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        key: str | None,
        score: float,
        max_fanout: int | None,
        files: Mapping[str, CsvTable],
    ):
        self._spark = next(iter(tables.values())).sparkSession
        self._inputs = dict(tables)
        self.key = key
        self.score = round(score, 3)
        self.mode = "apart" if key is None else "joined"
        self.reason = KEPT_APART if key is None else None
        self._max_fanout = max_fanout
        self._files = files

    @cached_property
    def rows_per_input(self) -> DataFrame:
        counts = [(i, n, t.count()) for i, (n, t) in enumerate(self._inputs.items())]
        return self._spark.createDataFrame([(n, c) for _, n, c in counts], "name string, rows bigint")

    @cached_property
    def file_notes(self) -> DataFrame:
        """One row per CSV input that was not read as it stands."""
        return file_notes(self._spark, self._files)

    @cached_property
    def tables(self) -> dict[str, DataFrame] | None:
        if self.mode == "joined":
            return None
        named: dict[str, DataFrame] = {}
        for name, table in self._inputs.items():
            short = stem(name)[:STEM_LENGTH]
            unique, number = short, 2
            while unique in named:
                unique, number = f"{short}_{number}", number + 1
            named[unique] = table
        return named

    @cached_property
    def _join(self) -> FullJoin:
        tables = list(self._inputs.values())
        keys = [column_named(t, self.key) for t in tables]
        return FullJoin(list(self._inputs), tables, keys)

    @cached_property
    def fanout(self) -> DataFrame | None:
        if self.mode == "apart":
            return None
        steps = [(i + 1, n, rows) for i, (n, rows) in enumerate(zip(list(self._inputs)[1:], self._join.rows_after()))]
        return self._spark.createDataFrame(steps, "step bigint, name string, rows bigint")

    def _checked(self) -> FullJoin:
        if self._max_fanout is not None:
            largest = max(self._join.rows_after())
            if largest > self._max_fanout:
                raise ValueError(f"the join would give {largest} rows, more than the {self._max_fanout} allowed")
        return self._join

    @cached_property
    def joined(self) -> DataFrame | None:
        return None if self.mode == "apart" else self._checked().result()

    @cached_property
    def joined_in_order(self) -> DataFrame | None:
        """The joined rows in the order of their keys, null keys last, in balanced ranges of keys."""
        return None if self.mode == "apart" else self._checked().result(ordered=True)

    @cached_property
    def summary(self) -> DataFrame:
        """(mode, join_column, overlap_score, final_row_count, null_key_rows, reason) in one row.

        ``null_key_rows`` of the result have a null key: every row without a key meets every other table's such rows.
        """
        joined = self.mode == "joined"
        rows, without_key = (self._join.rows_after()[-1], self._join.null_key_rows) if joined else (None, None)
        schema = "mode string, join_column string, overlap_score double, final_row_count bigint, null_key_rows bigint, reason string"
        return self._spark.createDataFrame([(self.mode, self.key, self.score, rows, without_key, self.reason)], schema)


def gather(
    tables: Mapping[str, DataFrame | CsvTable],
    min_overlap: float = MIN_KEY_OVERLAP,
    max_fanout: int | None = None,
) -> GatherResult:
    """Combine two or more named tables, in order; CSV tables bring their notes along.

    ``max_fanout`` refuses a join that would give more rows; the count is known beforehand.
    """
    if len(tables) < 2:
        raise ValueError("gather needs at least two tables")
    files = {n: t for n, t in tables.items() if isinstance(t, CsvTable)}
    ordered = {n: ensure_row_order(t.df if n in files else t) for n, t in tables.items()}
    key, score = choose_key(list(ordered.values()), min_overlap)
    return GatherResult(ordered, key, score, max_fanout, files)
