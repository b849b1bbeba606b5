"""Run queries against their SQL: python -m checks.compare [sf] [query ...]"""

from __future__ import annotations

import math
import sys
import time

from checks.oracles import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


UNWANTED = ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin")
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def same_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted, floats compared to nine digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, name: str) -> str | None:
    """None if the query and its SQL agree, else what differs. The plan must not pair all rows or call Python."""
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if bad := [node for node in UNWANTED if node in plan]:
        return f"its plan has {bad}"
    mine = same_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = same_rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = dict(df.dtypes)
    odd = {d[0]: (kinds[d[0]], str(d[1])) for d in cursor.description if SAME_TYPE.get(kinds[d[0]]) != str(d[1]).upper()}
    if odd:
        return f"types {odd}"
    if mine != theirs:
        here = [r for r in mine if r not in set(theirs)][:3]
        there = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} rows against {len(theirs)}; only here {here}; only there {there}"
    return None


def main() -> int:
    from checks.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    wanted = sys.argv[2:] or list(queries())
    spark, con = session(), duckdb_connection(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name) if name in oracle_sql() else "no SQL"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:800]}"
        failed += found is not None
        print(f"{name:26} {time.time() - start:6.2f}s {found or 'ok'}"[:1500], flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
