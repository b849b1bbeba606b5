"""Records that span pieces of text files: where each begins, found by all tasks at once.

A reader that cuts files at a separator cannot tell whether a piece lies inside quotes: that depends on all text before
it. But what a piece does to the state is known without it, so pieces are looked at twice. First, each piece's effect
is narrowed to two small numbers; within a split they are combined in order, and the splits' effects, few against the
pieces, are combined over each file. Then the state at the start of each split is known, records are numbered, and
only pieces of records that have several are brought together. Nothing but a record has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators.skew import is_small
from gristmill.operators.store import keep

UNCLOSED = "A quote in this file is never closed: "

_FILE, _START, _AT = "file", "_gm_start", "_gm_at"
_SPLIT = (_FILE, _START)


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, _gm_start, _gm_at, value): the pieces of files between separators, in the order of _gm_at in their split."""
    return spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_START),
        F.monotonically_increasing_id().alias(_AT),
        "value",
    )


def _before(order: list[str], *by: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(order: list[str], *by: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _joined(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with what is known of their split: a table that is kept, and broadcast if it was measured as small."""
    return rows.join(F.broadcast(splits) if is_small(splits) else splits, list(_SPLIT), "left")


def _flips(sets: Column, swaps: Column) -> dict[str, Column]:
    """Effects on a state of 0 or 1: ``sets`` is the state that a row sets or null, ``swaps`` whether it turns it over.

    Within rows in order, with S the turns so far, the state is that of the last row that set it, turned S times since.
    """
    return {"_gm_sets": sets.cast("int"), "_gm_swaps": swaps.cast("int")}


def _state(entry: Column, order: list[str], *by: str) -> Column:
    """The state before each row, from the effects of the rows before it; entry is that before the first."""
    turns = F.coalesce(F.sum("_gm_swaps").over(_before(order, *by)), F.lit(0))
    marked = F.last(F.col("_gm_mark"), ignorenulls=True).over(_before(order, *by))
    return F.pmod(F.coalesce(marked, entry) + turns, F.lit(2)).cast("int")


def _with_marks(rows: DataFrame, order: list[str], *by: str) -> DataFrame:
    """_gm_mark: the state that a row sets, turned back by all turns so far."""
    turns = F.sum("_gm_swaps").over(_upto(order, *by))
    return rows.withColumn("_gm_mark", F.when(F.col("_gm_sets").isNotNull(), F.pmod(F.col("_gm_sets") + turns, F.lit(2))))


def _entries(effects: DataFrame) -> DataFrame:
    """Per split with effects (file, start, at, _gm_sets, _gm_swaps) those of the whole split, then its state of entry.

    Splits without effects are not among them: they pass on what they get. Returns file, _gm_start, entry, leave.
    """
    marked = _with_marks(effects, [_AT], *_SPLIT)
    totals = marked.groupBy(*_SPLIT).agg(F.max_by("_gm_mark", F.when(F.col("_gm_mark").isNotNull(), F.col(_AT))).alias("_gm_mark"), F.sum("_gm_swaps").alias("_gm_swaps"))
    own = totals.select(*_SPLIT, F.pmod(F.col("_gm_mark") + F.col("_gm_swaps"), F.lit(2)).alias("_gm_sets"), F.pmod("_gm_swaps", F.lit(2)).alias("_gm_swaps"))
    own = _with_marks(own.withColumn("_gm_swaps", F.when(F.col("_gm_sets").isNull(), F.col("_gm_swaps")).otherwise(0)), [_START], _FILE)
    entry = _state(F.lit(0), [_START], _FILE)
    return own.withColumn("entry", entry).select(*_SPLIT, "entry", F.coalesce("_gm_sets", F.pmod(F.col("entry") + F.col("_gm_swaps"), F.lit(2))).cast("int").alias("leave"))


# CSV: the state is whether a line begins inside quotes.

_INSIDE = r'[^"]*+(?:""[^"]*+)*+"'
_QUOTED = '"' + _INSIDE


def _opens(line: Column) -> Column:
    """Does a line that begins outside quotes leave a field's quotes open? A quote within a field is an ordinary character."""
    return F.regexp_replace(line, "(^|,)" + _QUOTED, "$1").rlike('(^|,)"')


def _stays(line: Column) -> Column:
    """Does a line that begins inside quotes end inside quotes, the same or later ones?"""
    rest = F.regexp_replace(F.regexp_replace(line, "^" + _INSIDE, ""), "(,)" + _QUOTED, "$1")
    return ~line.rlike("^" + _INSIDE) | rest.rlike(',"')


def _csv_effects(lines: DataFrame) -> DataFrame:
    """Lines with their effects: the state after each, from outside and from inside quotes."""
    line = F.col("value")
    # Most lines have no quote at all.
    quoted = F.contains(line, F.lit('"'))
    after = lines.withColumns({"_gm_out": F.when(quoted, _opens(line)).otherwise(False), "_gm_in": F.when(quoted, _stays(line)).otherwise(True)})
    sets = F.when(F.col("_gm_out") == F.col("_gm_in"), F.col("_gm_out"))
    return after.withColumns(_flips(sets, F.col("_gm_out") & ~F.col("_gm_in"))).drop("_gm_out", "_gm_in")


def csv_spans_lines(lines: DataFrame) -> bool:
    """Does a quoted field of the lines (value) hold a line break? If not, each line is a record."""
    quoted = lines.filter(F.contains("value", F.lit('"')))
    return not quoted.filter(_opens(F.col("value"))).isEmpty()


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, record_number, record) from lines (file, _gm_start, _gm_at, value) as pieces() gives them, kept.

    Numbers start at 1 in each file and count blank records. Line breaks inside quotes stay; one at a record's end goes.
    """
    effects = _csv_effects(lines)
    narrow = effects.drop("value").filter("_gm_sets is not null or _gm_swaps = 1")
    entries = keep(_entries(narrow))
    last = entries.groupBy(_FILE).agg(F.max_by("leave", _START).alias("leave"))
    open_ = last.filter("leave = 1").agg(F.min(_FILE)).first()[0]
    if open_ is not None:
        raise ValueError(UNCLOSED + open_)
    # Splits without effects get what the split before them left.
    splits = lines.select(*_SPLIT).distinct().join(entries, list(_SPLIT), "left")
    carried = F.coalesce("entry", F.last("leave", ignorenulls=True).over(_before([_START], _FILE)), F.lit(0))
    known = keep(splits.select(*_SPLIT, carried.alias("entry")))
    marked = _with_marks(_joined(effects, known), [_AT], *_SPLIT)
    state = marked.withColumn("_gm_state", _state(F.col("entry"), [_AT], *_SPLIT))
    after = F.when(F.col("_gm_sets").isNotNull(), F.col("_gm_sets")).otherwise(F.pmod(F.col("_gm_state") + F.col("_gm_swaps"), F.lit(2)))
    begins, ends = F.col("_gm_state") == 0, after == 0
    numbered = state.withColumns({"_gm_begins": begins, "_gm_ends": ends})
    return _collected(numbered, "\n").withColumn("record", F.regexp_replace("record", r"\r$", ""))


def _collected(rows: DataFrame, separator: str) -> DataFrame:
    """(file, record_number, record) from pieces with _gm_begins and _gm_ends; what never ends is no record."""
    counted = F.sum(F.col("_gm_begins").cast("bigint")).over(_upto([_AT], *_SPLIT))
    placed = keep(rows.withColumn("_gm_n", counted).select(*_SPLIT, _AT, "value", "_gm_begins", "_gm_ends", "_gm_n"))
    totals = placed.groupBy(*_SPLIT).agg(F.max("_gm_n").alias("_gm_n"))
    offset = F.coalesce(F.sum("_gm_n").over(_before([_START], _FILE)), F.lit(0))
    numbered = _joined(placed, keep(totals.select(*_SPLIT, offset.alias("_gm_offset"))))
    numbered = numbered.withColumn("record_number", F.col("_gm_offset") + F.col("_gm_n"))
    whole = F.col("_gm_begins") & F.col("_gm_ends")
    single = numbered.filter(whole).select(_FILE, "record_number", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct(_START, _AT, "value")))
    several = numbered.filter(~whole).groupBy(_FILE, "record_number").agg(parts.alias("parts"), F.max("_gm_ends").alias("ends")).filter("ends")
    return single.unionByName(several.select(_FILE, "record_number", F.array_join("parts.value", separator).alias("record")))


# JSON: pieces end at closing braces; the state is whether a piece begins inside a string, and how deep in brackets.

_HEAD = r"^[\x{FEFF}\s]*\["


def _brackets(value: Column) -> Column:
    """Opening less closing brackets of a piece, which holds no closing brace."""
    def count(mark: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(mark), F.lit("")))

    return count("{") + count("[") - count("]")


def _json_effects(found: DataFrame) -> DataFrame:
    """Pieces with _gm_swaps, whether they turn the state over, and their depth from outside and inside strings."""
    value = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    strings = r'"[^"]*+(?:"|\z)'
    outside = F.regexp_replace(value, strings, "")
    inside = F.regexp_replace(F.regexp_replace(value, r'^[^"]*+(?:"|\z)', ""), strings, "")
    swaps = F.pmod(quotes, F.lit(2))
    # The brace at the end counts where it is outside strings.
    depths = {"_gm_out": _brackets(outside) - (1 - swaps), "_gm_in": _brackets(inside) - swaps}
    return found.withColumns({"_gm_swaps": swaps, **depths})


def json_array_records(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """(file, record_number, record) of files that hold one array of objects each; None if a file holds something else.

    Numbers start at 1 in each file. A record is the text of an object, whatever is nested in it.
    """
    effects = _json_effects(pieces(spark, path, "}"))
    turned = F.pmod(F.coalesce(F.sum("_gm_swaps").over(_before([_AT], *_SPLIT)), F.lit(0)), F.lit(2))
    narrow = effects.select(*_SPLIT, _AT, "_gm_swaps", "_gm_out", "_gm_in", F.col("value").rlike(_HEAD).alias("head"))
    narrow = narrow.withColumn("_gm_turned", turned)
    same, other = [F.when(F.col("_gm_turned") == s, F.col("_gm_out")).otherwise(F.col("_gm_in")) for s in (0, 1)]
    totals = narrow.groupBy(*_SPLIT).agg(
        F.sum("_gm_swaps").alias("swaps"), F.sum(same).alias("out"), F.sum(other).alias("in"), F.min_by("head", _AT).alias("head")
    )
    before = _before([_START], _FILE)
    totals = totals.withColumn("entry", F.pmod(F.coalesce(F.sum("swaps").over(before), F.lit(0)), F.lit(2)))
    deep = F.when(F.col("entry") == 0, F.col("out")).otherwise(F.col("in"))
    known = keep(totals.withColumn("depth", F.coalesce(F.sum(deep).over(before), F.lit(0))))
    heads = known.groupBy(_FILE).agg(F.min_by("head", _START).alias("head"))
    if not heads.agg(F.bool_and("head")).first()[0]:
        return None
    rows = _joined(effects, known.select(*_SPLIT, "entry", "depth"))
    state = F.pmod(F.col("entry") + F.coalesce(F.sum("_gm_swaps").over(_before([_AT], *_SPLIT)), F.lit(0)), F.lit(2))
    rows = rows.withColumn("_gm_state", state)
    rows = rows.withColumn("_gm_deep", F.when(F.col("_gm_state") == 0, F.col("_gm_out")).otherwise(F.col("_gm_in")))
    rows = rows.withColumn("_gm_to", F.col("depth") + F.sum("_gm_deep").over(_upto([_AT], *_SPLIT)))
    begins = (F.col("_gm_state") == 0) & (F.col("_gm_to") - F.col("_gm_deep") <= 1)
    ends = (F.pmod(F.col("_gm_state") + F.col("_gm_swaps"), F.lit(2)) == 0) & (F.col("_gm_to") == 1)
    rows = rows.withColumns({"_gm_begins": begins, "_gm_ends": ends})
    found = _collected(rows, "}")
    text = F.regexp_replace(F.concat("record", F.lit("}")), r"^[\x{FEFF}\s,\[]+", "")
    return found.withColumn("record", text)


def file_ranks(found: DataFrame) -> DataFrame:
    """(file, rank): the files of records in the order of their paths; kept, to be broadcast if measured as small."""
    files = found.select(_FILE).distinct()
    ranked = keep(files.withColumn("rank", F.row_number().over(Window.orderBy(_FILE)).cast("bigint")))
    return F.broadcast(ranked) if is_small(ranked) else ranked
