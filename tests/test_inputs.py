"""How the queries build the files they read."""

import glob

import gristmill as g
from checks import queries
from gristmill.naming import ROW


def test_one_array_is_written_in_turn(spark, tmp_path):
    records = spark.range(0, 50, 1, 5).selectExpr("""concat('{"k":', id, '}') as record""")
    path = str(tmp_path / "array")
    queries.write_array(records, path)
    (file,) = glob.glob(f"{path}/part-*")
    assert open(file).read() == "[" + ",\n ".join(f'{{"k":{i}}}' for i in range(50)) + "]\n"
    assert sorted(r.k for r in g.read_json(spark, path).drop(ROW).collect()) == list(range(50))


def test_line_breaks_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "sf"
    rows = spark.range(0, 80, 1, 8).selectExpr("id as doc_id", "concat('a\\n\"b\", ', id) as text", "'en' as lang", "'s' as source", "7 as n_chars")
    rows.write.parquet(str(folder / "documents.parquet"))
    path = str(tmp_path / "csv")
    monkeypatch.setattr(queries, "scratch", lambda spark: path)
    assert queries.csv_line_breaks(spark, str(folder)).count() == 80
    assert len(glob.glob(f"{path}/part-*")) > 2
