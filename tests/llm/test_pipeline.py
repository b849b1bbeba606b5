import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_decontaminate import brute as brute_contamination  # noqa: E402
from test_minhash import brute as brute_components  # noqa: E402
from test_passages import brute as brute_passages  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from gristmill.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_are_registered():
    names = set(spark_entry.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    pytest.importorskip("duckdb")
    from checks.compare import duckdb_connection, same_rows

    df = queries.queries()[name](spark, SF_DIR)
    cursor = duckdb_connection(SF_DIR).execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert same_rows(df.columns, [tuple(r) for r in df.collect()]) == same_rows(names, cursor.fetchall())


@needs_data
def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        results.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert results[-1].columns == columns
        docs = results[-1]
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in results[:4]]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 0").collect()}
    first = {i for i, _ in rows[0]}
    assert len(toxic & first) <= 0.2 * len(toxic) and len(clean - first) <= 0.05 * len(clean)
    assert sorted(rows[1]) == sorted((i, t) for i, t in brute_passages(rows[0], 50) if t.strip() or not dict(rows[0])[i].strip())
    kept = {i for i, _, component in brute_components(rows[1], corpus_pipeline.NEAR_PERCENT) if i == component}
    assert sorted(rows[2]) == sorted((i, t) for i, t in rows[1] if i in kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(rows[2], items) if r[-1]}
    assert sorted(rows[3]) == sorted((i, t) for i, t in rows[2] if i not in bad)
    assert {r.doc_id for r in results[4].collect()} == {i for i, _ in rows[3]}
    assert all(r.n_chars == len(r.text) for r in results[3].collect())


def test_odd_rows(spark, documents, odd_rows, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item text"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_rows, []):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            n = docs.count()
        assert bool(n) == bool(rows)
