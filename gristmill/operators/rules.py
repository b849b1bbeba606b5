"""Column rules of clean: decide them from aggregates, apply them as expressions.

Order of the rules for a text column: markers to null, trim, dates, known categories,
casing, numbers. A rule that does not fit a column never enters that column's expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import BLANK_MARKERS, CATEGORY_GROUPS, DATE_LIKE_SHARE, DATE_PARSED_SHARE
from gristmill.functions import dates, numbers, text
from gristmill.functions.text import is_digest
from gristmill.naming import ROW, IdNames, col, data_columns, is_number, is_text, is_time
from gristmill.operators.cells import COLUMN, cells, spell_out, value_counts
from gristmill.operators.date_texts import DateTexts, date_facts
from gristmill.operators.skew import byte_size, fits, hot_keys, lookup
from gristmill.operators.store import keep

BEFORE = "_gm_before"


@dataclass
class ColumnRules:
    """What clean does to one column."""

    name: str
    kind: str  # text, number, flag, time or as_is
    date: bool = False
    group: int | None = None
    number_type: str | None = None
    spellings: bool = False
    changes: dict[str, int] = field(default_factory=dict)


@dataclass
class Rules:
    """The decided rules of a table, with the cells each rule changes."""

    columns: list[ColumnRules]
    spellings: DataFrame | None = None
    # Columns whose spellings are too large to be broadcast, and their frequent values.
    respelled_apart: list[str] = field(default_factory=list)
    hot_values: DataFrame | None = None
    date_texts: DateTexts | None = None

    def by_name(self, name: str) -> ColumnRules:
        return next(c for c in self.columns if c.name == name)

    def changes(self) -> list[tuple[str, str, int]]:
        return [(c.name, rule, n) for c in self.columns for rule, n in c.changes.items() if n]


def text_facts(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """Counts that settle all text rules but dates and casing: one scan, one small aggregate."""
    if not names:
        return {}
    value, stripped, lower, number = (F.col(c) for c in ("value", "stripped", "lower", "number"))
    long = cells(df, [[col(n)] for n in names], ["value"]).withColumn("stripped", text.strip(value))
    long = long.withColumn("lower", text.short_lower(stripped))
    long = long.withColumn("number", numbers.may_be_number(stripped) & numbers.is_number_text(stripped))
    blank = F.coalesce(lower.isin(BLANK_MARKERS), F.lit(False))
    long = long.withColumn("filled", value.isNotNull() & ~blank)
    filled = F.col("filled")
    facts = {
        "nulls": F.count_if(value.isNull()),
        "blank": F.count_if(value.isNotNull() & ~filled),
        "filled": F.count_if(filled),
        "trimmed": F.count_if(filled & (value != stripped)),
        **date_facts(stripped, filled),
        "numbers": F.count_if(filled & number),
        "whole": F.count_if(filled & number & numbers.is_whole_text(stripped)),
        "codes": F.count_if(filled & number & numbers.is_code(stripped)),
        "cased": F.count_if(filled & text.may_have_case(stripped)),
    }
    for i, group in enumerate(CATEGORY_GROUPS):
        spelled = text.spelled(lower, group)
        facts[f"group{i}"] = F.count_if(filled & spelled.isNotNull())
        facts[f"respelled{i}"] = F.count_if(filled & (spelled != stripped))
    rows = long.groupBy(COLUMN).agg(*[e.alias(k) for k, e in facts.items()]).collect()
    empty = dict.fromkeys(facts, 0)
    found = {names[r[COLUMN]]: {k: r[k] for k in facts} for r in rows}
    return {n: found.get(n, empty) for n in names}


def is_date_text(filled: int, date_like: int, parsed: int) -> bool:
    return filled > 0 and date_like / filled >= DATE_LIKE_SHARE and parsed / filled >= DATE_PARSED_SHARE


def _maybe_dates(facts: dict[str, dict]) -> list[str]:
    return [n for n, f in facts.items() if f["filled"] and f["date_like"] / f["filled"] >= DATE_LIKE_SHARE]


def decide(df: DataFrame, ids: IdNames, keep_timestamps: bool = False) -> Rules:
    """Decide every column's rules. Only a few numbers per column reach the driver."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = data_columns(df)
    texts = [n for n in names if is_text(types[n])]
    flags = [n for n in names if types[n].typeName() == "boolean"]
    facts = text_facts(df, texts)
    likely = {n: text.tidy(col(n)) for n in _maybe_dates(facts) if n not in ids}
    date_texts = DateTexts(df, likely, facts) if likely else None
    parsed = {n: date_texts.counts(n) for n in likely}
    flag_nulls = df.agg(*[F.count_if(col(n).isNull()).alias(n) for n in flags]).first().asDict() if flags else {}

    columns = []
    for name in names:
        if name in facts:
            columns.append(_decide_text(name, facts[name], parsed.get(name), name in ids))
        elif is_number(types[name]):
            columns.append(ColumnRules(name, "number"))
        elif name in flags:
            columns.append(ColumnRules(name, "flag" if flag_nulls[name] else "as_is"))
        elif is_time(types[name]) and name not in ids and not keep_timestamps:
            columns.append(ColumnRules(name, "time"))
        else:
            columns.append(ColumnRules(name, "as_is"))
    rules = Rules(columns, date_texts=date_texts)
    _decide_casing(df, rules, facts, parsed)
    return rules


def _decide_text(name: str, facts: dict, parsed: dict | None, is_id: bool) -> ColumnRules:
    rules = ColumnRules(name, "text")
    filled = facts["filled"]
    rules.changes["blank_like_converted_to_null"] = facts["blank"]
    rules.changes["whitespace_trimmed"] = facts["trimmed"]
    if parsed and is_date_text(filled, facts["date_like"], parsed["parsed"]):
        rules.date = True
        rules.changes["dates_standardized"] = parsed["rewritten"]
    for i in range(len(CATEGORY_GROUPS)):
        if filled and facts[f"group{i}"] == filled:
            rules.group = i
            rules.changes["categories_standardized"] = facts[f"respelled{i}"]
            break
    if filled and not is_id and facts["numbers"] == filled and not facts["codes"]:
        rules.number_type = "bigint" if facts["whole"] == filled else "double"
        rules.changes["converted_to_numeric"] = filled
    return rules


def _before_casing(df: DataFrame, columns: Sequence[ColumnRules], date_texts: DateTexts | None) -> DataFrame:
    """Text columns after markers, trimming, dates and categories."""
    df = df.withColumns({c.name: text.tidy(col(c.name)) for c in columns})
    dated = [c.name for c in columns if c.date]
    if dated:
        df = date_texts.rewrite(df, dated)
    grouped = [c for c in columns if c.group is not None]
    if grouped:
        spelled = {c.name: text.category(col(c.name), CATEGORY_GROUPS[c.group]) for c in grouped}
        df = df.withColumns({n: F.coalesce(e, col(n)) for n, e in spelled.items()})
    return df


def _decide_casing(df: DataFrame, rules: Rules, facts: dict, parsed: dict) -> None:
    """Find, per column, the spellings that give way to a more frequent one."""
    open_ = [
        c
        for c in rules.columns
        if c.kind == "text"
        and facts[c.name]["cased"]
        and c.group is None
        and not (c.date and parsed[c.name]["parsed"] == facts[c.name]["filled"])
    ]
    if not open_:
        return
    staged = _before_casing(df.select(ROW, *[col(c.name) for c in open_]), open_, rules.date_texts)
    names = [c.name for c in open_]
    table = spelling_changes(staged, names)
    measures = (F.sum("n").alias("n"), F.bool_or(is_digest(F.col("best"))).alias("long"), byte_size(table).alias("size"))
    found = {r[COLUMN]: r for r in table.groupBy(COLUMN).agg(*measures).collect()}
    for number, c in enumerate(open_):
        c.changes["casing_standardized"] = found[number]["n"] if number in found else 0
        c.spellings = number in found
    if not found:
        return
    sizes = {number: r["size"] for number, r in found.items()}
    if any(r["long"] for r in found.values()):
        table = whole_spellings(staged, names, table)
        sizes = {r[COLUMN]: r["size"] for r in table.groupBy(COLUMN).agg(byte_size(table).alias("size")).collect()}
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(COLUMN) + 1)
    rules.spellings = table.select(named.alias("_gm_name"), F.col("key").alias("_gm_key"), F.col("best").alias("_gm_best"))
    # Columns with few spellings are broadcast, smallest first, as long as they fit together.
    total = 0
    for number in sorted(sizes, key=sizes.get):
        total += sizes[number]
        if not fits(total):
            rules.respelled_apart.append(names[number])
    if rules.respelled_apart:
        apart = rules.respelled_apart
        named = F.element_at(F.array(*[F.lit(n) for n in apart]), F.col(COLUMN) + 1)
        counts = value_counts(staged, apart).select(named.alias("_gm_name"), F.col("key").alias("_gm_key"), "n")
        rows = facts[apart[0]]["nulls"] + facts[apart[0]]["blank"] + facts[apart[0]]["filled"]
        rules.hot_values = hot_keys(counts, ["_gm_name", "_gm_key"], rows)


def spelling_changes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, key, best, n): keys whose text is respelled as the text of key ``best``, in ``n`` cells.

    Of the spellings that differ in case only, the most frequent wins; the first in row
    order on a tie. The window runs over distinct values, already counted with map-side
    combining, so its groups hold the spellings of one text and not the rows.
    """
    rivals = Window.partitionBy(COLUMN, "folded").orderBy(F.desc("n"), "first_row")
    counted = value_counts(df, names, fold=True).withColumn("best", F.first("key").over(rivals))
    return keep(counted.filter("key <> best").select(COLUMN, "key", "best", "n"))


def whole_spellings(df: DataFrame, names: Sequence[str], changes: DataFrame) -> DataFrame:
    """Spelling changes with the whole texts in place of digests."""
    best = changes.select(COLUMN, F.col("best").alias("key")).distinct()
    texts = spell_out(df, names, best)
    spelled = texts.select(COLUMN, F.col("key").alias("best"), F.col("value").alias("_gm_text"))
    joined = changes.join(spelled, [COLUMN, "best"])
    return keep(joined.select(COLUMN, "key", F.col("_gm_text").alias("best"), "n"))


def apply(df: DataFrame, rules: Rules) -> DataFrame:
    """The table after the column rules, original cells kept aside in ``_before``."""
    types = dict(df.dtypes)
    texts = [c for c in rules.columns if c.kind == "text"]
    originals = F.struct(*[col(c.name) for c in rules.columns]).alias(BEFORE)
    out = df.select(*[col(c.name) for c in rules.columns], originals, ROW)
    out = _before_casing(out, texts, rules.date_texts) if texts else out
    plain = {}
    for c in rules.columns:
        if c.kind == "number":
            plain[c.name] = numbers.no_nan(col(c.name), types[c.name])
        elif c.kind == "flag":
            plain[c.name] = text.as_text(col(c.name), "boolean")
        elif c.kind == "time":
            plain[c.name] = dates.iso_text(col(c.name))
    out = out.withColumns(plain) if plain else out
    for c in texts:
        if c.spellings and c.name not in rules.respelled_apart:
            table = rules.spellings.filter(F.col("_gm_name") == c.name).select("_gm_key", "_gm_best")
            out = out.withColumn("_gm_key", text.compact(col(c.name)))
            out = lookup(out, table, ["_gm_key"], how="left", small=True)
            out = out.withColumn(c.name, F.coalesce("_gm_best", col(c.name))).drop("_gm_key", "_gm_best")
    if len(rules.respelled_apart) == 1:
        out = _respelled_alone(out, rules, rules.respelled_apart[0])
    elif rules.respelled_apart:
        out = _respelled_apart(out, rules)
    cast = {c.name: numbers.to_number(col(c.name), c.number_type) for c in texts if c.number_type}
    out = out.withColumns(cast) if cast else out
    return out.select(*[col(c.name) for c in rules.columns], BEFORE, ROW)


def _respelled_alone(df: DataFrame, rules: Rules, name: str) -> DataFrame:
    """df with the spellings of the only column whose spellings are too large to be broadcast: rows and texts move once."""
    keyed = df.withColumns({"_gm_name": F.lit(name), "_gm_key": text.compact(col(name))})
    found = lookup(keyed, rules.spellings, ["_gm_name", "_gm_key"], rules.hot_values, how="left")
    return found.withColumn(name, F.coalesce("_gm_best", col(name))).drop("_gm_name", "_gm_key", "_gm_best")


def _respelled_apart(df: DataFrame, rules: Rules) -> DataFrame:
    """df with the spellings of all columns whose spellings are too large to be broadcast.

    Only cells leave, as (row, column, key); those that change come back together as one list per row, in one join for
    all columns. That join is broadcast where few rows change. Rows that share a place in the row order share a list, so
    each cell takes the entry of its own key.
    """
    names = rules.respelled_apart
    long = cells(df, [[text.compact(col(n))] for n in names], ["_gm_key"], carried=[ROW]).filter("_gm_key is not null")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(COLUMN) + 1)
    found = lookup(long.withColumn("_gm_name", named), rules.spellings, ["_gm_name", "_gm_key"], rules.hot_values)
    entry = F.struct(F.col(COLUMN).alias("i"), F.col("_gm_key").alias("key"), F.col("_gm_best").alias("best"))
    changed = keep(found.groupBy(F.col(ROW).alias("_gm_of")).agg(F.collect_set(entry).alias("_gm_changes")))
    few = fits(changed.agg(F.coalesce(F.sum(F.aggregate("_gm_changes", F.lit(16).cast("bigint"), _entry_bytes)), F.lit(0))).first()[0])
    out = df.join(F.broadcast(changed) if few else changed, F.col(ROW) == F.col("_gm_of"), "left")

    def best(i: int, name: str) -> Column:
        own = F.filter("_gm_changes", lambda x: (x["i"] == i) & (x["key"] == text.compact(col(name))))
        return F.coalesce(F.get(own, F.lit(0))["best"], col(name))

    return out.withColumns({n: best(i, n) for i, n in enumerate(names)}).drop("_gm_of", "_gm_changes")


def _entry_bytes(total: Column, entry: Column) -> Column:
    return total + 16 + F.octet_length(entry["key"]) + F.octet_length(entry["best"])
