"""Full outer joins of several tables on one key, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import numbers, text
from gristmill.naming import ROW, col, data_columns, is_number, is_time
from gristmill.operators import skew
from gristmill.operators.order import POSITION_BITS
from gristmill.operators.store import keep

KEY = "_gm_key"
SALT = "_gm_salt"


def common_type(kinds: Sequence[T.DataType]) -> str:
    """The type under which key columns of these types are compared and kept."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0].simpleString()
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return "bigint"
    if all(isinstance(k, (T.IntegralType, T.DecimalType)) for k in kinds):
        scale = max(getattr(k, "scale", 0) for k in kinds)
        whole = max(k.precision - k.scale if isinstance(k, T.DecimalType) else 19 for k in kinds)
        if whole + scale <= 38:
            return f"decimal({whole + scale},{scale})"
        return "string"
    if all(is_number(k) for k in kinds):
        return "double"
    if all(is_time(k) for k in kinds):
        return "timestamp_ntz"
    return "string"


class FullJoin:
    """Tables folded left to right with null-safe full outer joins on one key.

    The rows per key are counted first, map-side combined. The counted keys, each of them once,
    then serve as the left side of a chain of left joins, which gives the same rows as full
    outer joins: every table is shuffled once at most, the growing result never again, and
    Spark may broadcast a small table, which a full outer join does not allow. The counts also
    give the exact size of every step and name the keys too hot for one task.
    """

    def __init__(self, names: Sequence[str], tables: Sequence[DataFrame], keys: Sequence[str]):
        kinds = [t.schema[k].dataType for t, k in zip(tables, keys)]
        kind = common_type(kinds)
        self.key_name = keys[0]
        self._out: list[str] = data_columns(tables[0])
        # Spark tells column names apart without regard to case, so clashes are found that way.
        taken = {n.lower() for n in self._out}
        self._tables = []
        for i, (name, table, key) in enumerate(zip(names, tables, keys)):
            value = numbers.no_nan(col(key), kinds[i].simpleString())
            as_key = text.key_text(value, kinds[i].simpleString()) if kind == "string" else value.cast(kind)
            renamed = []
            for n in data_columns(table):
                if n == key:
                    continue
                new = n
                if i:
                    if new.lower() in taken:
                        new = f"{n}_{name.rsplit('.', 1)[0]}"
                    while new.lower() in taken:
                        new += "_2"
                    taken.add(new.lower())
                    self._out.append(new)
                renamed.append(col(n).alias(new))
            self._tables.append(table.select(as_key.alias(KEY), *renamed, ROW))

    @cached_property
    def _counts(self) -> DataFrame:
        """Rows per key, n0, n1, ... per table."""
        parts = []
        for i, t in enumerate(self._tables):
            zeros = [F.lit(0).cast("bigint").alias(f"n{j}") for j in range(len(self._tables)) if j != i]
            counted = t.groupBy(KEY).agg(F.count(F.lit(1)).alias(f"n{i}"))
            parts.append(counted.select(KEY, f"n{i}", *zeros))
        sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(self._tables))]
        return keep(reduce(DataFrame.unionByName, parts).groupBy(KEY).agg(*sums))

    def _rows(self, upto: int) -> Column:
        """Rows a key has once the tables up to a number are joined."""
        rows = F.col("n0")
        for i in range(1, upto + 1):
            n = F.col(f"n{i}")
            rows = F.when(rows == 0, n).when(n == 0, rows).otherwise(rows * n)
        return rows

    @cached_property
    def _sizes(self) -> list[int]:
        sums = [F.sum(self._rows(i).cast("decimal(38,0)")) for i in range(len(self._tables))]
        return [int(s or 0) for s in self._counts.agg(*sums).first()]

    @cached_property
    def null_key_rows(self) -> int:
        """Rows of the result whose key is null: null keys meet null keys."""
        rows = self._rows(len(self._tables) - 1).cast("decimal(38,0)")
        return int(self._counts.filter(F.col(KEY).isNull()).agg(F.sum(rows)).first()[0] or 0)

    def rows_after(self) -> list[int]:
        """Exact row count after each join."""
        return self._sizes[1:]

    @cached_property
    def _hot(self) -> DataFrame | None:
        """Keys with many rows in a table: that table's number and the salts to deal its rows out to."""
        width = len(self._tables)
        most = F.greatest(*[F.col(f"n{i}") for i in range(width)])
        total = self._counts.agg(*[F.sum(f"n{i}") for i in range(width)]).first()
        limit = max(skew.HOT_ROWS, sum(n or 0 for n in total) * skew.HOT_SHARE)
        owner = F.array_position(F.array(*[F.col(f"n{i}") for i in range(width)]), most) - 1
        hot = self._counts.filter(most >= limit).select(
            F.col(KEY).alias("_gm_hot_key"),
            owner.cast("int").alias("_gm_owner"),
            F.ceil(most / F.lit(limit)).cast("int").alias("_gm_salts"),
        )
        hot = keep(hot)
        return None if hot.isEmpty() else F.broadcast(hot)

    def _salted(self, number: int) -> DataFrame:
        """A table with the salts of its rows: dealt out in the hot key's longest table,
        repeated under every salt in the others, 0 for all other keys.

        The table is written once, so that a task that is run again deals its rows alike.
        """
        table = keep(self._tables[number])
        marked = table.join(self._hot, F.col(KEY).eqNullSafe(F.col("_gm_hot_key")), "left")
        dealt = F.array(F.pmod(F.xxhash64(ROW), F.col("_gm_salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_gm_salts") - 1)
        salts = (
            F.when(F.col("_gm_owner").isNull(), F.array(F.lit(0)))
            .when(F.col("_gm_owner") == number, dealt)
            .otherwise(every)
        )
        marked = marked.withColumn(SALT, F.explode(salts)).withColumn(f"_gm_in{number}", F.lit(True))
        return marked.drop("_gm_hot_key", "_gm_salts", "_gm_owner")

    def _spine(self) -> DataFrame:
        """Every key once, a hot key once per salt."""
        keys = self._counts.join(self._hot, F.col(KEY).eqNullSafe(F.col("_gm_hot_key")), "left").drop("_gm_hot_key")
        salts = F.sequence(F.lit(0), F.coalesce(F.col("_gm_salts"), F.lit(1)) - 1)
        return keys.withColumn(SALT, F.explode(salts))

    def _placed(self, spine: DataFrame, parts: int) -> DataFrame:
        """Keys, or keys and salts, with the output partition of their rows: ranges of keys with about as many rows each.

        The rows that every key gives are known, so neither the join nor a sample of it has to run for this. Keys are
        ranged and sorted alone; a running total is taken within each range, and the driver sees one sum per range.
        """
        salts = F.coalesce(F.col("_gm_salts"), F.lit(1)) if "_gm_salts" in spine.columns else F.lit(1)
        rows = (self._rows(len(self._tables) - 1) / salts).alias("_gm_rows")
        order = [F.col(KEY).asc_nulls_last(), *([F.col(SALT)] if SALT in spine.columns else [])]
        ranged = spine.withColumn("_gm_rows", rows).repartitionByRange(*order).sortWithinPartitions(*order)
        placed = keep(ranged.withColumn("_gm_at", F.monotonically_increasing_id()))
        part = F.shiftright("_gm_at", POSITION_BITS)
        sums = placed.groupBy(part.alias("part")).agg(F.sum("_gm_rows").alias("rows")).orderBy("part").collect()
        before, total = [], 0.0
        for r in sums:
            before.append((r["part"], total))
            total += r["rows"]
        start = placed.sparkSession.createDataFrame(before, "_gm_range bigint, _gm_start double")
        running = F.sum("_gm_rows").over(Window.partitionBy("_gm_range").orderBy("_gm_at")) - F.col("_gm_rows")
        place = F.floor((F.col("_gm_start") + running) * F.lit(parts) / F.lit(max(total, 1.0)))
        summed = placed.withColumn("_gm_range", part).join(F.broadcast(start), "_gm_range")
        return summed.withColumn("_gm_part", F.least(place, F.lit(parts - 1)).cast("int")).drop("_gm_range", "_gm_start", "_gm_rows", "_gm_at")

    def result(self, ordered: bool = False) -> DataFrame:
        """The joined rows; ``ordered`` puts them in the order of their keys, null last.

        Then partitions, and with them written files, follow each other in key order, and a hot key's salts may lie in
        several. Rows of a key and salt are in the order of the first table's rows, then of the second's, and so on.
        """
        numbers_ = range(len(self._tables))
        if self._hot is None:
            tables, joined, keys = self._tables, self._counts, [KEY]
        else:
            tables, joined, keys = [self._salted(i) for i in numbers_], self._spine(), [KEY, SALT]
        places = [f"_gm_row{i}" for i in numbers_] if ordered else []
        parts = int(self._counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if ordered:
            joined = self._placed(joined, parts)
        joined = joined.drop("_gm_salts", *[f"n{i}" for i in numbers_])
        for i, table in enumerate(tables):
            table = table.withColumnRenamed(ROW, f"_gm_row{i}") if ordered else table.drop(ROW)
            right = table.withColumnsRenamed({k: f"{k}_right" for k in keys})
            same = [F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in keys]
            joined = joined.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"{k}_right" for k in keys])
        if self._hot is not None:
            # A salt that no row of the hot key's longest table fell on stands for nothing.
            there = F.array(*[F.col(f"_gm_in{i}") for i in numbers_])
            joined = joined.filter(F.col("_gm_owner").isNull() | F.get(there, F.col("_gm_owner")).isNotNull())
        if ordered:
            inner = [F.col(c).asc_nulls_last() for c in [*keys, *places]]
            joined = joined.repartitionById(parts, F.col("_gm_part")).sortWithinPartitions(*inner)
        return joined.select(*[F.col(KEY).alias(n) if n == self.key_name else col(n) for n in self._out])
