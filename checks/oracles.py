"""The result of each query in SQL for DuckDB, worked out on its own from the same tables."""

from __future__ import annotations

from checks.messy import (
    CUSTOMER_LINES,
    DATED_ORDERS,
    KEYED_CUSTOMERS,
    KEYED_ORDERS,
    KEYED_SEGMENTS,
    MESSY_ORDERS,
    PLAIN_TEXTS,
    for_duckdb,
)

# Written out here, not taken from the library, so that a wrong value there is seen.
BLANK_MARKERS = "|n/a|n.a.|#n/a|na|null|none|nil|-|--|?|\\n|nan|unknown|missing".split("|")
CSV_NULL_TOKENS = (
    "|#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null"
).split("|")
CATEGORY_GROUPS = [
    {"m": "Male", "male": "Male", "f": "Female", "female": "Female"},
    {"y": "Yes", "yes": "Yes", "n": "No", "no": "No"},
    {"true": "True", "t": "True", "false": "False", "f": "False"},
]
DATE_LIKE = (
    r"(?i)\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

HELPER_NAMES = ["_id", "_key", "_before", "_k1", "_n", "_at", "_salt", "_best", "_first", "_day", "_m0"]
LOW = "abcdefghijklmnopqrstuvwxyz"
ROW_NO = "order_id * 10 + copy_no"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def blank(x: str) -> str:
    return f"lower({strip(x)}) IN {in_list(BLANK_MARKERS)}"


def tidy(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN NULL ELSE {strip(x)} END"


def date_text(x: str) -> str:
    parsed = ", ".join(f"try_strptime({x}, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y"))
    return f"strftime(coalesce({parsed}), '%Y-%m-%d')"


def category(x: str, group: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in group.items())
    return f"CASE lower({x}) {cases} END"


MESSY = f"m AS (SELECT *, CAST({ROW_NO} AS BIGINT) AS row_no FROM ({for_duckdb(MESSY_ORDERS)}))"
TIDY = f"""t AS (SELECT row_no, order_id, {tidy('status')} AS status, {tidy('priority')} AS priority,
  {tidy('order_date')} AS order_date, {tidy('amount')} AS amount, {tidy('urgent')} AS urgent FROM m)"""


def spellings(source: str, column: str) -> str:
    return f"""{column}_best AS (SELECT lower({column}) AS k, {column} AS best FROM
      (SELECT {column}, count(*) AS n, min(row_no) AS seen FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})
      QUALIFY row_number() OVER (PARTITION BY lower({column}) ORDER BY n DESC, seen) = 1)"""


# Messy orders after the column rules.
REPAIRED = f"""{MESSY}, {TIDY}, {spellings('t', 'status')}, {spellings('t', 'priority')},
r AS (SELECT t.row_no, t.order_id, s.best AS status, p.best AS priority,
    coalesce({date_text('t.order_date')}, t.order_date) AS order_date,
    TRY_CAST(t.amount AS DOUBLE) AS amount, {category('t.urgent', CATEGORY_GROUPS[1])} AS urgent
  FROM t LEFT JOIN status_best s ON lower(t.status) = s.k LEFT JOIN priority_best p ON lower(t.priority) = p.k),
kept AS (SELECT * FROM r WHERE NOT (status IS NULL AND priority IS NULL AND order_date IS NULL
  AND amount IS NULL AND urgent IS NULL))"""

MESSY_COLUMNS = ["order_id", "status", "priority", "order_date", "amount", "urgent"]
CELLS = ", ".join(MESSY_COLUMNS)
FILLED = f"""{REPAIRED}, f AS (SELECT row_no, order_id, coalesce(status, 'Unknown') AS status,
  coalesce(priority, 'Unknown') AS priority, coalesce(order_date, 'Unknown') AS order_date,
  coalesce(amount, (SELECT median(amount) FROM kept)) AS amount, coalesce(urgent, 'Unknown') AS urgent FROM kept)"""
EQUAL_ROWS = f"""{REPAIRED}, e AS (SELECT *, count(*) OVER (PARTITION BY {CELLS}) AS n,
  min(row_no) OVER (PARTITION BY {CELLS}) AS first_row FROM kept)"""
ORIGINALS = ", ".join(f"m.{c}" for c in MESSY_COLUMNS)

_DIFFERS = ", ".join(
    f"CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 1 THEN '{c}' END"
    for c in MESSY_COLUMNS
    if c != "order_id"
)
CONFLICTS = f"""{EQUAL_ROWS},
many AS (SELECT order_id FROM kept GROUP BY order_id HAVING count(*) > 1),
lone AS (SELECT * FROM e WHERE n = 1 AND order_id IN (SELECT order_id FROM many)),
differs AS (SELECT order_id, concat_ws(', ', {_DIFFERS}) AS cols FROM lone GROUP BY order_id)"""

_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in MESSY_COLUMNS) + ")"
_ANY_MISSING = " OR ".join(f"{c} IS NULL" for c in MESSY_COLUMNS)


def date_column_sql(column: str) -> str:
    like = f"count(*) FILTER (WHERE regexp_matches({column}, {lit(DATE_LIKE)}))"
    parsed = f"count({date_text(column)})"
    likely = f"{like} >= 0.5 * count({column})"
    return f"""SELECT '{column}' AS "column", count({column}) AS filled, {like} AS date_like,
      CASE WHEN {likely} THEN {parsed} END AS parsed,
      ({likely} AND {parsed} >= 0.9 * count({column})) AS is_date FROM m"""


# Profiles

NUMBERS = ("bigint", "int", "double")


def as_text(column: str, kind: str) -> str:
    return f"CAST({column} AS VARCHAR)" if kind != "string" else column


def profile_sql(source: str, columns: dict[str, str], ids: list[str]) -> str:
    parts = []
    for c, kind in columns.items():
        number = kind in NUMBERS
        stats = (
            f"round(avg({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median, "
            f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max"
            if number
            else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, "
            "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
        )
        marked = "CAST(NULL AS BIGINT)" if number else f"count(*) FILTER (WHERE {blank(as_text(c, kind))})"
        unique = "TRUE" if c in ids else f"count(DISTINCT {c}) >= 0.9 * count({c})"
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percent, count({c}) = 0 AS all_values_null,
            count(DISTINCT {c}) AS unique_count, {stats}, {marked} AS blank_like_count,
            CASE WHEN {unique} THEN nullif(count({c}) - count(DISTINCT {c}), 0) END AS duplicate_value_count
            FROM {source}"""
        )
    return " UNION ALL ".join(parts)


TABLES = {
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "documents": {
        "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
    },
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}
MESSY_KINDS = {c: "string" for c in MESSY_COLUMNS} | {"order_id": "bigint"}
IDS = [
    "o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "c_custkey", "event_id", "user_id", "doc_id",
    "conv_id", "order_id",
]


def top_sql(source: str, column: str, order: str, show: str, top: int, least: int = 1) -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column",
        row_number() OVER (ORDER BY n DESC, seen) AS rank, {show}, n
      FROM (SELECT {column} AS v, count(*) AS n, min({order}) AS seen FROM {source}
        WHERE {column} IS NOT NULL GROUP BY {column}) WHERE n >= {least}) WHERE rank <= {top}"""


# Analysis


def pearson(source: str, columns: dict[str, str], top: int = 15) -> str:
    names = list(columns)
    parts = [
        f"SELECT {i} AS i, {j} AS j, '{a}' AS column_a, '{b}' AS column_b, corr({columns[a]}, {columns[b]}) AS r FROM {source}"
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i < j
    ]
    return f"""SELECT column_a, column_b, round(r, 4) AS correlation,
      concat(CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END,
        CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END) AS strength
      FROM ({' UNION ALL '.join(parts)}) WHERE r IS NOT NULL AND NOT isnan(r)
      ORDER BY abs(round(r, 4)) DESC, i, j LIMIT {top}"""


def candidates(source: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count({c}) AS filled FROM {source}
        HAVING count(DISTINCT {c}) BETWEEN 2 AND 50 AND count(DISTINCT {c}) <= 0.5 * count({c})"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def comparisons(source: str, groups: list[str], measures: list[str]) -> str:
    parts = [
        f"""SELECT '{g}' AS group_by, '{m}' AS metric, CAST({g} AS VARCHAR) AS "group", avg({m}) AS a
        FROM {source} WHERE {g} IS NOT NULL GROUP BY {g} HAVING avg({m}) IS NOT NULL"""
        for g in groups
        for m in measures
    ]
    return f"""SELECT group_by, metric, rank, "group", round(a, 4) AS average, rank = 1 AS is_highest,
        rank = n AS is_lowest
      FROM (SELECT *, row_number() OVER (PARTITION BY group_by, metric ORDER BY a DESC, "group") AS rank,
        count(*) OVER (PARTITION BY group_by, metric) AS n FROM ({' UNION ALL '.join(parts)}))
      WHERE n >= 2 AND (rank <= 8 OR rank = n)"""


def trend(source: str, at: str, date_column: str, unit: str, measures: list[str]) -> str:
    averages = ", ".join(f"avg({m}) AS a{i}" for i, m in enumerate(measures))
    ends = " UNION ALL ".join(
        f"""SELECT '{m}' AS "column", count(*) AS periods, arg_min(a{i}, p) AS first, arg_max(a{i}, p) AS last FROM p"""
        for i, m in enumerate(measures)
    )
    return f"""WITH d AS (SELECT *, {at} AS moment FROM {source}),
      p AS (SELECT date_trunc('{unit}', moment) AS p, {averages} FROM d WHERE moment IS NOT NULL GROUP BY 1)
      SELECT "column", '{date_column}' AS date_column, '{unit}' AS period, periods AS period_count,
        (SELECT strftime(min(moment), '%Y-%m-%d') FROM d) AS start, (SELECT strftime(max(moment), '%Y-%m-%d') FROM d) AS "end",
        round(first, 4) AS first_period_average, round(last, 4) AS last_period_average,
        CASE WHEN first <> 0 THEN round((last - first) / abs(first) * 100, 2) END AS percent_change,
        CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'flat' END AS direction
      FROM ({ends}) WHERE first IS NOT NULL AND last IS NOT NULL"""


def fences(source: str, column: str) -> str:
    return f"""(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT
      quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))"""


def outlier_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < low OR {c} > high) AS outlier_count,
        round(count(*) FILTER (WHERE {c} < low OR {c} > high) / count({c}) * 100, 2) AS outlier_percent,
        round(any_value(low), 4) AS lower_bound, round(any_value(high), 4) AS upper_bound
        FROM {source}, {fences(source, c)} WHERE q1 <> q3
        HAVING count({c}) >= 5 AND count(*) FILTER (WHERE {c} < low OR {c} > high) > 0"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def span_sql(source: str, at: str) -> str:
    days = f"CAST(floor(epoch(max({at}) - min({at})) / 86400) AS BIGINT)"
    return f"""SELECT '{source}' AS name, count({at}) AS rows, {days} AS days,
      CASE WHEN {days} >= 730 THEN 'year' WHEN {days} >= 90 THEN 'month' WHEN {days} >= 14 THEN 'week'
        ELSE 'day' END AS period FROM {source}"""


# Gather


def overlap_sql(tables: dict[str, str], columns: list[tuple[str, list[str]]]) -> str:
    """tables: name -> SQL; columns: shown name with its name in each table."""
    ctes, parts = [f"{n} AS ({sql})" for n, sql in tables.items()], []
    for k, (shown, names) in enumerate(columns):
        for n, c in zip(tables, names):
            ctes.append(f"{n}_{k} AS (SELECT DISTINCT lower({strip(f'CAST({c} AS VARCHAR)')}) AS v FROM {n} WHERE {c} IS NOT NULL)")
        shares = []
        for n in tables:
            others = " UNION ALL ".join(f"SELECT v FROM {o}_{k}" for o in tables if o != n)
            shares.append(f"(SELECT count(*) FILTER (WHERE v IN ({others})) / count(*) FROM {n}_{k})")
        parts.append(f"""SELECT '{shown}' AS "column", ({' + '.join(shares)}) / {len(tables)} AS score""")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


KEYED = {n: for_duckdb(s) for n, s in (("o", KEYED_ORDERS), ("c", KEYED_CUSTOMERS), ("s", KEYED_SEGMENTS))}
THREE = f"""WITH o AS ({KEYED['o']}), c AS ({KEYED['c']}), s AS ({KEYED['s']}),
  oc AS (SELECT coalesce(o.cust_id, c.cust_id) AS cust_id, order_no, o.amount AS amount, name,
      c.amount AS amount_customers FROM o FULL JOIN c ON o.cust_id IS NOT DISTINCT FROM c.cust_id),
  ocs AS (SELECT coalesce(oc.cust_id, s.Cust_ID) AS cust_id, order_no, amount, name, amount_customers, segment
      FROM oc FULL JOIN s ON oc.cust_id IS NOT DISTINCT FROM s.Cust_ID)"""

_LINES = for_duckdb(CUSTOMER_LINES)
_BALANCE = "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS DOUBLE) END"
CSV_TABLE = f"""SELECT c_custkey AS cust_no,
  CASE WHEN c_custkey % 20 = 1 THEN concat(c_name, ', Inc.') ELSE c_name END AS name, {_BALANCE} AS balance,
  CASE WHEN c_custkey % 50 = 5 THEN 'north' WHEN c_custkey % 9 = 2 THEN ' ?' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 50 = 5 THEN ' east' WHEN c_custkey % 33 = 4 THEN NULL
    ELSE lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS nation_code
  FROM customer WHERE NOT (c_custkey % 50 = 5 AND c_custkey % 33 <> 4)"""


def oracle_sql() -> dict[str, str]:
    rules = {
        "status": ("blank_like_converted_to_null", blank("status")),
        "amount": ("blank_like_converted_to_null", blank("amount")),
    }
    blanks = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{rule}' AS metric, count(*) FILTER (WHERE {test}) AS value FROM m"""
        for c, (rule, test) in rules.items()
    )
    t_vs_r = "t JOIN r USING (row_no)"
    changes = f"""WITH {FILLED}, report AS ({blanks}
      UNION ALL SELECT 'status', 'whitespace_trimmed', count(*) FROM m
        WHERE NOT {blank('status')} AND status <> {strip('status')}
      UNION ALL SELECT 'order_date', 'dates_standardized', count(*) FROM {t_vs_r} WHERE t.order_date <> r.order_date
      UNION ALL SELECT 'urgent', 'categories_standardized', count(*) FROM {t_vs_r} WHERE t.urgent <> r.urgent
      UNION ALL SELECT 'status', 'casing_standardized', count(*) FROM {t_vs_r} WHERE t.status <> r.status
      UNION ALL SELECT 'priority', 'casing_standardized', count(*) FROM {t_vs_r} WHERE t.priority <> r.priority
      UNION ALL SELECT 'amount', 'converted_to_numeric', count(amount) FROM r
      {' '.join(f"UNION ALL SELECT '{c}', 'missing_values_filled', count(*) - count({c}) FROM kept" for c in MESSY_COLUMNS)})
      SELECT * FROM report WHERE value > 0"""
    counts = f"""WITH {FILLED}, n AS (SELECT (SELECT count(*) FROM m) AS all_rows, (SELECT count(*) FROM kept) AS kept_rows,
        (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM f)) AS final_rows),
      e AS (SELECT *, count(*) OVER (PARTITION BY {CELLS}) AS n FROM kept),
      many AS (SELECT order_id FROM kept GROUP BY order_id HAVING count(*) > 1)"""
    conflicts = "(SELECT count(*) FROM e WHERE n = 1 AND order_id IN (SELECT order_id FROM many))"
    flags = [k for group in CATEGORY_GROUPS for k in group]
    flag = f"[{', '.join(lit(k) for k in flags)}][CAST(o_orderkey % {len(flags)} AS INT) + 1]"
    loud = f"translate(text, '{LOW}', '{LOW.upper()}')"
    docs = f"SELECT text, doc_id * 2 AS row_no FROM documents UNION ALL SELECT {loud}, doc_id * 2 + 1 FROM documents"
    profiles = {f"profile_{n}": profile_sql(n, kinds, IDS) for n, kinds in TABLES.items()}
    dated = for_duckdb(DATED_ORDERS)
    texts = {
        "a": "SELECT doc_id, text, lang FROM documents",
        "b": f"""SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, lang,
          CASE WHEN doc_id % 3 = 0 THEN concat('* ', text) ELSE concat(' ', {loud}) END AS text FROM documents""",
    }
    plain = for_duckdb(PLAIN_TEXTS)
    return {
        "blank_to_null": f"""WITH {MESSY} SELECT row_no, CASE WHEN {blank('status')} THEN NULL ELSE status END AS status,
          CASE WHEN {blank('amount')} THEN NULL ELSE amount END AS amount FROM m""",
        "trim_whitespace": f"""SELECT doc_id, length(x) AS chars, md5(x) AS digest
          FROM (SELECT doc_id, {strip("concat(' ', chr(9), ' ', text, '  ', chr(10))")} AS x FROM documents)""",
        "standardize_dates": f"WITH {REPAIRED} SELECT row_no, order_date FROM r",
        "standardize_categories": f"WITH {REPAIRED} SELECT row_no, urgent FROM r",
        "category_groups": f"""SELECT o_orderkey, flag, {', '.join(f"{category('flag', x)} AS as{i}"
          for i, x in enumerate(CATEGORY_GROUPS))} FROM (SELECT o_orderkey, {flag} AS flag FROM orders)""",
        "standardize_casing": f"WITH {REPAIRED} SELECT row_no, status, priority FROM r",
        "casing_first_seen": f"""WITH d AS (SELECT row_no, {tidy('text')} AS text FROM ({docs})), {spellings('d', 'text')}
          SELECT row_no, md5(best) AS digest FROM d LEFT JOIN text_best ON lower(d.text) = k""",
        "convert_numbers": f"WITH {REPAIRED} SELECT row_no, round(amount, 4) AS amount FROM r",
        "change_counts": changes,
        "fill_missing": f"WITH {FILLED} SELECT row_no, {CELLS.replace('amount', 'round(amount, 4) AS amount')} FROM f",
        "keep_leading_zero_codes": """SELECT c_custkey AS row_no, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS code,
          CAST(c_nationkey AS BIGINT) AS number, 'string,bigint' AS kinds FROM customer""",
        "timestamps_as_text": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts FROM events",
        "date_columns": f"WITH {MESSY} {' UNION ALL '.join(date_column_sql(c) for c in MESSY_COLUMNS if c != 'order_id')}",
        "empty_rows": f"""WITH {REPAIRED} SELECT 'All fields empty except the ID' AS reason, {ORIGINALS}, m.row_no
          FROM m WHERE row_no NOT IN (SELECT row_no FROM kept)""",
        "missing_rows": f"""WITH {REPAIRED}, x AS (SELECT row_no, concat('Missing values in: ', {_MISSING}) AS reason
          FROM kept WHERE {_ANY_MISSING}) SELECT reason, {ORIGINALS}, m.row_no FROM x JOIN m USING (row_no)""",
        "duplicate_rows": f"""WITH {EQUAL_ROWS}, x AS (SELECT row_no, n, dense_rank() OVER (ORDER BY first_row) AS g
          FROM e WHERE n > 1) SELECT concat('Exact duplicate - matches ', n - 1, ' other row(s) (group ', g, ')') AS reason,
          {ORIGINALS}, m.row_no FROM x JOIN m USING (row_no)""",
        "conflicting_rows": f"""WITH {CONFLICTS} SELECT
          concat('Same order_id as another row, but differs in: ', cols) AS reason, {ORIGINALS}, m.row_no
          FROM lone JOIN differs USING (order_id) JOIN m USING (row_no)""",
        "cleaned_rows": f"""WITH {FILLED} SELECT {CELLS.replace('amount', 'round(amount, 4) AS amount')},
          min(row_no) AS row_no FROM f GROUP BY {CELLS}""",
        "clean_summary": f"""{counts} SELECT 'original_row_count' AS metric, all_rows AS value FROM n
          UNION ALL SELECT 'empty_rows_removed', all_rows - kept_rows FROM n
          UNION ALL SELECT 'rows_with_missing_values', (SELECT count(*) FROM kept WHERE {_ANY_MISSING})
          UNION ALL SELECT 'duplicate_rows_removed', kept_rows - final_rows FROM n
          UNION ALL SELECT 'conflicting_duplicate_rows', {conflicts}
          UNION ALL SELECT 'final_row_count', final_rows FROM n""",
        "duplicate_documents": f"""WITH d AS (SELECT doc_id AS row_no, text AS original, lang, {tidy('text')} AS text
            FROM documents), {spellings('d', 'text')},
          e AS (SELECT *, count(*) OVER (PARTITION BY k, lang) AS n, min(row_no) OVER (PARTITION BY k, lang) AS f
            FROM d LEFT JOIN text_best ON lower(d.text) = k)
          SELECT concat('Exact duplicate - matches ', n - 1, ' other row(s) (group ',
            dense_rank() OVER (ORDER BY f), ')') AS reason, md5(original) AS digest, row_no FROM e WHERE n > 1""",
        "written_clean": f"""{counts} SELECT 'cleaned' AS name, final_rows AS rows FROM n
          UNION ALL SELECT 'duplicates', (SELECT count(*) FROM e WHERE n > 1)
          UNION ALL SELECT 'conflicts', {conflicts}
          UNION ALL SELECT 'missing_values', (SELECT count(*) FROM kept WHERE {_ANY_MISSING})
          UNION ALL SELECT 'empty_rows', all_rows - kept_rows FROM n""",
        "read_csv": CSV_TABLE,
        "csv_types": f"""SELECT (SELECT count(*) FROM ({CSV_TABLE})) AS rows, "column", kind FROM (VALUES
          ('cust_no', 'bigint'), ('name', 'string'), ('balance', 'double'), ('segment', 'string'),
          ('nation_code', 'string')) AS v("column", kind)""",
        "csv_malformed_lines": f"SELECT line FROM ({_LINES}) WHERE k % 50 = 5 AND k % 33 <> 4",
        "csv_latin_text": f"""SELECT doc_id, md5(CASE WHEN body IN {in_list(CSV_NULL_TOKENS)} THEN NULL
          ELSE {strip('body')} END) AS digest, TRUE AS noted FROM ({plain})""",
        "read_json": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
        "write_formats": " UNION ALL ".join(
            f"SELECT '{f}' AS format, count(c_name) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer"
            for f in ("csv", "json", "parquet")
        ),
        "gather_folder": """SELECT coalesce(c_custkey, o_custkey) AS cust_id, c_name, c_mktsegment, count(o_orderkey) AS orders,
          sum(o_totalprice) AS total, max(c_acctbal) AS balance, 'cust_id' AS join_key
          FROM customer FULL JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey GROUP BY 1, 2, 3""",
        "id_columns": " UNION ALL ".join(
            f"""SELECT '{t}' AS name, '{c}' AS "column", count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM {t}"""
            for t, c in (
                ("events", "event_id"), ("events", "user_id"), ("documents", "doc_id"), ("labels", "doc_id"),
                ("pages", "page_id"), ("embeddings", "vec_id"), ("benchmark", "item_id"), ("conversations", "conv_id"),
            )
        ),
        **profiles,
        "profile_messy": f"WITH {MESSY} {profile_sql('m', MESSY_KINDS, IDS)}",
        "profile_table": f"""WITH {MESSY} SELECT 'row_count' AS metric, count(*) AS value FROM m
          UNION ALL SELECT 'column_count', {len(MESSY_COLUMNS)} UNION ALL SELECT 'duplicate_row_count',
          (SELECT count(*) FROM m) - (SELECT count(*) FROM (SELECT DISTINCT {CELLS} FROM m))""",
        "top_values": f"""{top_sql('customer', 'c_name', 'c_custkey', 'v AS value', 5)} UNION ALL
          {top_sql('customer', 'c_mktsegment', 'c_custkey', 'v AS value', 5)}""",
        "top_long_values": " UNION ALL ".join(
            top_sql("documents", c, "doc_id", "md5(v) AS digest", 5) for c in ("text", "lang", "source")
        ),
        "casing_examples": f"""WITH {MESSY}, s AS ({' UNION ALL '.join(
            f'''SELECT '{c}' AS "column", {c} AS spelling, lower({c}) AS k, min(row_no) AS seen FROM m
            WHERE {c} IS NOT NULL GROUP BY 2, 3''' for c in MESSY_COLUMNS if c != 'order_id')}),
          g AS (SELECT "column", k, min(seen) AS seen FROM s GROUP BY 1, 2 HAVING count(*) > 1),
          first AS (SELECT "column", arg_min(k, seen) AS k FROM g GROUP BY 1)
          SELECT "column", spelling FROM s JOIN first USING ("column", k)""",
        "duplicate_values": " UNION ALL ".join(
            f"""SELECT * FROM ({top_sql("events", c, "event_id", "CAST(v AS VARCHAR) AS value", 3, 2)})
            WHERE {c in IDS} OR (SELECT count(DISTINCT {c}) >= 0.9 * count({c}) FROM events)"""
            for c in TABLES["events"]
        ),
        "duplicate_row_examples": f"""WITH {MESSY}, e AS (SELECT *, count(*) OVER (PARTITION BY {CELLS}) AS n FROM m)
          SELECT {CELLS}, row_no FROM e WHERE n > 1 ORDER BY row_no LIMIT 3""",
        "correlations": pearson(
            "lineitem", {c: c for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}
        ),
        "correlations_with_gaps": pearson(
            "orders",
            {
                "gaps": "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END",
                "part": "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 2 + o_custkey END",
                "customer": "o_custkey",
            },
        ),
        "group_candidates": f"""{candidates('events', ['ts', 'event_type', 'props'])} UNION ALL
          {candidates('orders', ['o_orderstatus', 'o_orderdate', 'o_orderpriority'])}""",
        "group_comparisons": comparisons(
            "lineitem",
            ["l_linestatus", "l_returnflag"],
            ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ),
        "group_comparisons_many": comparisons("part", ["p_type", "p_brand"], ["p_retailprice", "p_size"]),
        "date_span": f"""{span_sql('orders', 'o_orderdate')} UNION ALL {span_sql('lineitem', 'l_shipdate')}
          UNION ALL {span_sql('events', 'ts')}""",
        "trend_by_year": trend("orders", "o_orderdate", "o_orderdate", "year", ["o_totalprice"]),
        "trend_by_week": trend("events", "ts", "ts", "week", ["value"]),
        "trend_text_dates": trend(f"({dated})", "strptime(ordered_on, '%m/%d/%Y')", "ordered_on", "year", ["amount"]),
        "period_averages": """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS period,
          round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price
          FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""",
        "outliers": outlier_sql("events", ["value"]),
        "outliers_of_lines": outlier_sql(
            "lineitem", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        ),
        "outlier_examples": f"""SELECT 'value' AS "column", rank, round(value, 4) AS value FROM (SELECT value,
          row_number() OVER (ORDER BY event_id) AS rank FROM events, {fences('events', 'value')}
          WHERE value < low OR value > high) WHERE rank <= 5""",
        "analyze_all": f"""SELECT 'columns' AS part, {len(TABLES['orders'])} AS findings
          UNION ALL SELECT 'correlations', 0
          UNION ALL SELECT 'trends', (SELECT count(*) FROM ({trend('orders', 'o_orderdate', 'o_orderdate', 'year', ['o_totalprice'])}))
          UNION ALL SELECT 'group_comparisons',
            (SELECT count(*) FROM ({comparisons('orders', ['o_orderstatus', 'o_orderpriority'], ['o_totalprice'])}))
          UNION ALL SELECT 'outliers', (SELECT count(*) FROM ({outlier_sql('orders', ['o_totalprice'])}))
          UNION ALL SELECT 'outlier_examples', (SELECT least(count(*), 5) FROM orders, {fences('orders', 'o_totalprice')}
            WHERE o_totalprice < low OR o_totalprice > high)""",
        "shared_overlap": f"""SELECT "column", round(score, 4) AS score FROM ({overlap_sql(KEYED,
            [('cust_id', ['cust_id', 'cust_id', 'Cust_ID'])])})""",
        "text_overlap": f"""SELECT "column", round(score, 4) AS score FROM ({overlap_sql(texts,
            [(c, [c, c]) for c in ('doc_id', 'text', 'lang')])})""",
        "gather_summary": f"""SELECT 'joined' AS mode, 'cust_id' AS join_column,
          round((SELECT score FROM ({overlap_sql(KEYED, [('cust_id', ['cust_id', 'cust_id', 'Cust_ID'])])})), 3) AS overlap_score,
          (SELECT count(*) FROM ({THREE} SELECT * FROM ocs)) AS final_row_count""",
        "gather_two": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, text, lang, source, n_chars, quality, toxic
          FROM documents d FULL JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""",
        "gather_three": f"{THREE} SELECT * FROM ocs",
        "gather_fanout": f"""{THREE} SELECT CAST(1 AS BIGINT) AS step, 'customers' AS name, (SELECT count(*) FROM oc) AS rows
          UNION ALL SELECT 2, 'segments', (SELECT count(*) FROM ocs)""",
        "gather_rows": """SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows UNION ALL
          SELECT 'customers', (SELECT count(*) FROM customer) UNION ALL SELECT 'segments', (SELECT count(*) FROM customer)""",
        "gather_apart": """SELECT 'apart' AS mode, 'orders' AS name, (SELECT count(*) FROM orders) AS rows UNION ALL
          SELECT 'apart', 'part', (SELECT count(*) FROM part)""",
        "whole_numbers_with_gaps": """SELECT o_orderkey AS row_no,
          CASE WHEN o_orderkey % 17 <> 0 THEN 9007199254740993 + o_orderkey END AS big,
          (SELECT count(*) FROM orders) AS final_rows FROM orders""",
        "fill_decimals": """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 3
            THEN CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DECIMAL(12, 0)) END AS balance FROM customer)
          SELECT c_custkey AS row_no, coalesce(CAST(balance AS DOUBLE),
            (SELECT quantile_cont(CAST(balance AS DOUBLE), 0.5) FROM b)) AS balance FROM b""",
        "conflicts_with_helper_names": f"""SELECT o_orderkey * 10 + c AS row_no,
          'Same order_id as another row, but differs in: {', '.join(HELPER_NAMES)}' AS reason, o_orderkey AS order_id,
          {', '.join(f"concat('{n} ', c) AS {n}" for n in HELPER_NAMES)}
          FROM orders, (VALUES (0), (1)) AS v(c) WHERE o_orderkey % 101 = 0""",
        "gather_mixed_keys": """SELECT coalesce(c_custkey, o_custkey) AS cust_id, orders, c_name, nation
          FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o FULL JOIN
            (SELECT c_custkey, c_name, CASE WHEN c_custkey % 20 <> 0 THEN c_nationkey END AS nation FROM customer) c
            ON o_custkey = c_custkey""",
        "gather_dates": """SELECT strftime(coalesce(o.day, l.day), '%Y-%m-%d') AS day, orders, lines
          FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) o FULL JOIN
            (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS lines FROM lineitem GROUP BY 1) l
            ON o.day IS NOT DISTINCT FROM l.day""",
        "gather_decimals": """SELECT o_orderkey AS order_no, o_totalprice,
          CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders""",
        "csv_with_headers": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS c_mktsegment
          FROM customer""",
        "profile_csv": """WITH t AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS c_mktsegment
            FROM customer)
          SELECT 'c_custkey' AS "column", 'bigint' AS dtype, 0::BIGINT AS null_count, count(DISTINCT c_custkey) AS unique_count FROM t
          UNION ALL SELECT 'c_name', 'string', 0, count(DISTINCT c_name) FROM t
          UNION ALL SELECT 'c_mktsegment', 'string', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM t""",
        "csv_repeated_names": """SELECT c_custkey AS cust_no, c_name AS label, c_mktsegment AS label_1, 'label' AS repeated
          FROM customer""",
        "csv_malformed_places": f"""SELECT part, line_number, line FROM (SELECT CAST(k % 4 AS INTEGER) AS part, k, line,
            row_number() OVER (PARTITION BY k % 4 ORDER BY k) AS line_number FROM ({_LINES}))
          WHERE k % 50 = 5 AND k % 33 <> 4""",
        "csv_line_breaks": "SELECT doc_id, md5(coalesce(text, '')) AS digest, lang, source, n_chars FROM documents",
        "csv_record_numbers": """SELECT part, record_number, line, (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 5) AS rows FROM (
            SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS part, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS record_number,
              concat(c_custkey, ',"', c_name, CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), '5"" pipe,', chr(10)) ELSE ' 5"" ' END, '",', c_mktsegment,
                CASE WHEN c_custkey % 50 = 5 THEN concat(',"one', chr(10), 'more"') ELSE '' END) AS line FROM customer)
          WHERE c_custkey % 50 = 5""",
        "json_one_array": """SELECT o_orderkey, o_totalprice, o_custkey AS no, o_orderstatus AS status,
          concat('}{"', o_orderpriority, ']', chr(92)) AS note FROM orders""",
        "csv_no_rows": """SELECT count(*) AS rows, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names, true AS warned,
          CAST(0 AS BIGINT) AS profiled FROM customer WHERE false""",
        "first_seen_over_files": """SELECT c_custkey,
            CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) ELSE c_name END AS c_name FROM customer
          UNION ALL SELECT c_custkey, lower(c_name) FROM customer WHERE c_custkey % 10 = 0""",
        "read_json_array": """SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS BIGINT) AS s_nationkey,
          's_suppkey,s_name,s_acctbal,s_nationkey' AS names FROM supplier""",
        "correlations_many": pearson(
            "lineitem",
            {c: c for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}
            | {
                "charge": "l_extendedprice * (1 - l_discount)", "unit": "l_extendedprice / l_quantity",
                "half": "CASE WHEN l_orderkey % 2 = 0 THEN l_quantity + l_tax END", "squared": "l_quantity * l_quantity",
                "rest": "l_quantity - l_linenumber", "price_tax": "l_extendedprice * l_tax",
            },
        ),
        "written_gather": f"SELECT 'gathered' AS name, count(*) AS rows FROM ({THREE} SELECT * FROM ocs)",
        "gather_ordered": f"""{THREE} SELECT cust_id, CAST(total - rows + 1 AS BIGINT) AS first_place, CAST(total AS BIGINT) AS last_place, rows,
          (SELECT count(*) FROM ocs WHERE cust_id IS NULL) AS null_key_rows
          FROM (SELECT cust_id, count(*) AS rows, sum(count(*)) OVER (ORDER BY cust_id NULLS LAST) AS total FROM ocs GROUP BY cust_id)""",
        "gather_many_keys": """SELECT count(*) AS rows, count(o_orderstatus) AS met, 'k7' AS join_key, CAST(1 AS DOUBLE) AS score,
          true AS few_counted FROM orders""",
        "gather_file_notes": f"""SELECT 'customers.csv' AS name, count(*) AS malformed_rows_skipped,
          CAST(NULL AS VARCHAR) AS encoding_note FROM ({_LINES}) WHERE k % 50 = 5 AND k % 33 <> 4""",
    }
