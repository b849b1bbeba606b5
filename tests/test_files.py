import pytest

import gristmill as g
from gristmill.sources.csv import distinct_names, repeated_names


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def read(spark, tmp_path, text, encoding="utf-8", **options):
    return g.read_csv(spark, write(tmp_path / "t.csv", text, encoding), **options)


def data(table):
    df = table.df.orderBy("_row").drop("_row")
    return [tuple(r) for r in df.collect()]


def test_types_and_null_tokens(spark, tmp_path):
    text = "n,f,code,word,flag,gap\n1,1.5,007,a,True,1\n2,N/A,008,-,False,\n3, 2 ,009,null,TRUE,3\n"
    table = read(spark, tmp_path, text)
    assert table.df.dtypes[:-1] == [
        ("n", "bigint"), ("f", "double"), ("code", "string"), ("word", "string"), ("flag", "boolean"), ("gap", "bigint"),
    ]
    assert data(table) == [
        (1, 1.5, "007", "a", True, 1), (2, None, "008", "-", False, None), (3, 2.0, "009", None, True, 3),
    ]


def test_markers_the_reader_leaves_alone(spark, tmp_path):
    assert data(read(spark, tmp_path, "a,b\n?,x\n\\N,y\n NULL,z\n")) == [("?", "x"), ("\\N", "y"), (" NULL", "z")]


def test_long_lines_are_set_aside_and_short_ones_filled(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n1,2,3,4\n\n5,6\n"x, y","say ""hi""",9\n"7,8",9,10,11\n'
    table = read(spark, tmp_path, text, infer=False)
    assert data(table) == [("1", "2", "3"), ("5", "6", None), ("x, y", 'say "hi"', "9")]
    assert table.df.count() == 3 and table.df.select("b").count() == 3
    assert table.malformed_count == 2
    assert table.malformed_line_numbers == [3, 7]
    assert table.malformed.orderBy("line_number").first()["line"] == "1,2,3,4"


def test_twenty_line_numbers_are_listed(spark, tmp_path):
    table = read(spark, tmp_path, "a,b\n" + "1,2,3\n" * 30)
    assert table.malformed_count == 30 and table.malformed_line_numbers == list(range(2, 22))


def test_line_numbers_over_several_splits(spark, tmp_path):
    lines = [f"{i},x" if i % 97 else f"{i},x,y" for i in range(5000)]
    path = write(tmp_path / "big.csv", "a,b\n" + "\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        table = g.read_csv(spark, path)
        assert table.df.rdd.getNumPartitions() > 3
        found = [r["line_number"] for r in table.malformed.orderBy("line_number").collect()]
        values = [r[0] for r in data(table)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert found == [i + 2 for i in range(5000) if i % 97 == 0]
    assert values == [i for i in range(5000) if i % 97]


def test_latin_text_is_read_and_noted(spark, tmp_path):
    text = "city,n\nZürich,1\nCafé,2\nSão Paulo,3\n"
    table = read(spark, tmp_path, text, "latin-1")
    assert [r[0] for r in data(table)] == ["Zürich", "Café", "São Paulo"] and table.encoding_note
    table = read(spark, tmp_path, text)
    assert [r[0] for r in data(table)] == ["Zürich", "Café", "São Paulo"] and table.encoding_note is None


def test_repeated_names(spark, tmp_path):
    assert repeated_names("a,b,a,c,b,a\n") == ["a", "b"]
    assert distinct_names(["a", "A", "a", "", "b"]) == ["a", "A.1", "a.2", "Unnamed: 3", "b"]
    table = read(spark, tmp_path, "a,b,a\n1,2,3\n")
    assert table.duplicate_names == ["a"] and table.df.columns[:-1] == ["a", "b", "a.1"]
    assert g.profile(table.df).columns.count() == 3
    assert g.clean(table.df).cleaned.count() == 1


def test_no_data(spark, tmp_path):
    for text in ("", "\n", "\n\n"):
        with pytest.raises(ValueError, match="nothing to read"):
            read(spark, tmp_path, text)


def test_header_only(spark, tmp_path):
    table = read(spark, tmp_path, "a,b,c\n")
    assert table.df.count() == 0
    assert g.profile(table.df).warning
    result = g.clean(table.df)
    assert result.counts["final_row_count"] == 0 and result.warning


def test_line_breaks_in_quotes(spark, tmp_path):
    assert data(read(spark, tmp_path, 'a,b\n"x\ny",1\n', multi_line=True)) == [("x\ny", 1)]


def test_byte_order_mark(spark, tmp_path):
    assert read(spark, tmp_path, "﻿a,b\n1,2\n").df.columns[:2] == ["a", "b"]


def test_json_records(spark, tmp_path):
    text = '[{"z": 1, "name": "x", "code": "007", "num": "1.5", "seen_at": "2024-01-05T10:00:00", "tags": [1]},'
    text += '{"z": 2, "name": null, "code": "008", "num": "2", "seen_at": "Jan 8 2024", "late": true}]'
    df = g.read_json(spark, write(tmp_path / "t.json", text))
    assert df.columns == ["z", "name", "code", "num", "seen_at", "tags", "late", "_row"]
    kinds = dict(df.dtypes)
    assert (kinds["num"], kinds["code"], kinds["seen_at"]) == ("double", "string", "timestamp_ntz")
    assert g.profile(g.nested_to_text(df)).columns.count() == 7


def test_read_by_extension(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n int, v string").write.parquet(str(tmp_path / "t.parquet"))
    assert g.read_table(spark, str(tmp_path / "t.parquet")).columns == ["n", "v", "_row"]
    assert g.read_table(spark, write(tmp_path / "u.jsonl", '{"b": 1, "a": 2}\n')).columns[:2] == ["b", "a"]
    with pytest.raises(ValueError, match="Unsupported"):
        g.read_table(spark, "x.txt")


def test_discover(spark, tmp_path):
    for name in ("b.csv", "a.JSON", "c.txt", ".hidden.csv", "d.Parquet"):
        write(tmp_path / name, "x\n")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "e.csv", "x\n")
    spark.range(3).write.parquet(str(tmp_path / "e.parquet"))
    found = g.discover(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.JSON", "b.csv", "d.Parquet", "e.parquet"]
    assert g.discover(spark, f"file:{tmp_path}/")[0] == f"file:{tmp_path}/a.JSON"


def test_written_results(spark, frame, tmp_path):
    rows = [(1, "a", 5.0), (1, "a", 5.0), (2, "x", None), (2, "y", 1.0), (3, None, None)]
    result = g.clean(frame(rows, "id int, v string, n double"))
    for fmt in ("parquet", "csv", "json"):
        written = g.write_clean(result, str(tmp_path / fmt), fmt, ordered=True)
        assert set(written) == {"cleaned", "duplicates", "conflicts", "missing_values", "empty_rows"}
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.format(fmt).load(written["cleaned"])
        assert back.count() == result.counts["final_row_count"] and "_row" not in back.columns
    tidy = g.clean(frame([(1, "a"), (2, "b")], "id int, v string"))
    assert set(g.write_clean(tidy, str(tmp_path / "tidy"))) == {"cleaned"}


def test_gathered_tables_are_written(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "k int, a int")
    assert set(g.write_gather(g.gather({"a": a, "b": a}), str(tmp_path / "one"))) == {"gathered"}
    b = spark.createDataFrame([(9,)], "z int")
    assert set(g.write_gather(g.gather({"a.csv": a, "b.csv": b}), str(tmp_path / "two"))) == {"a", "b"}


def test_kept_tables_can_be_cleared(spark):
    from gristmill.operators.store import keep

    kept = keep(spark.range(3).toDF("n"))
    assert kept.count() == 3
    g.clear_kept_tables(spark)
    with pytest.raises(Exception):
        kept.count()


def test_long_digits_stay_text(spark, tmp_path):
    table = read(spark, tmp_path, "a,b\n99999999999999999999999,9223372036854775807\n1,2\n")
    assert [k for _, k in table.df.dtypes[:2]] == ["string", "bigint"]


def test_a_folder_is_gathered_with_notes(spark, tmp_path):
    write(tmp_path / "sales.csv", "order_id,amount\n1,5\n2,6\n3,7,8\n")
    write(tmp_path / "cost.json", '[{"order_id": 1, "cost": 2}, {"order_id": 2, "cost": 3}]')
    tables = g.read_tables(spark, [str(tmp_path)])
    assert list(tables) == ["cost.json", "sales.csv"]
    result = g.gather(tables)
    assert sorted(map(tuple, result.joined.collect())) == [(1, 2, 5), (2, 3, 6)]
    (note,) = result.file_notes.collect()
    assert tuple(note) == ("sales.csv", 1, [4], None, [])
    with pytest.raises(ValueError, match="at least two"):
        g.read_tables(spark, [str(tmp_path / "sales.csv")])


def test_files_of_different_headers_are_matched_by_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", "no,tree,park\n1,oak,North Park\n")
    b = write(tmp_path / "b.csv", "park,no,tree\nMill Lane,2,elm\n")
    c = write(tmp_path / "c.csv", "tree,no\nash,3\n")
    table = g.read_csv(spark, [a, b, c])
    assert table.df.columns == ["no", "tree", "park", "_row"]
    assert data(table) == [(1, "oak", "North Park"), (2, "elm", "Mill Lane"), (3, "ash", None)]


def test_rows_of_files_come_in_the_order_of_their_paths(spark, tmp_path):
    small = write(tmp_path / "part-0.csv", "k,v\n1,white pine\n")
    large = write(tmp_path / "part-1.csv", "k,v\n" + "".join(f"{i},{'x' * 200}\n" for i in range(2, 400)) + "400,White Pine\n")
    table = g.read_csv(spark, [large, small])
    assert data(table)[0] == (1, "white pine")
    repaired = {r["k"]: r["v"] for r in g.clean(table, ["k"]).repaired.collect()}
    assert repaired[400] == "white pine"


def test_long_records_that_span_lines_are_listed_whole(spark, tmp_path):
    text = 'a,b\n"first\nline",1\n"one\ntwo, three",4,5\nlast,6\n'
    table = read(spark, tmp_path, text, multi_line=True)
    assert data(table) == [("first\nline", 1), ("last", 6)]
    assert table.malformed_count == 1 and table.malformed_line_numbers == [3]  # the third record, header included
    assert table.malformed.first()["line"] == '"one\ntwo, three",4,5'


def test_csv_tables_go_straight_to_every_operation(spark, tmp_path):
    path = write(tmp_path / "trees.csv", "no,tree,tree\n1,oak,a\n2, elm ,b\n3,ash,c,d\n")
    table = g.read_table(spark, path)
    cleaned = g.clean(table, ["no"])
    assert [r["tree"] for r in cleaned.cleaned.orderBy("_row").collect()] == ["oak", "elm"]
    note = cleaned.file_notes.first()
    assert note["malformed_rows_skipped"] == 1 and note["malformed_row_numbers"] == [4]
    assert note["duplicate_column_names"] == ["tree"]
    assert g.profile(table).row_count == 2 and g.profile(table).file_notes.count() == 1
    assert g.analyze(table).file_notes.count() == 1
    assert g.clean(table.df).file_notes is None


def test_a_header_alone_gives_a_table_without_rows(spark, tmp_path):
    result = g.clean(read(spark, tmp_path, "a,b,c\n"))
    assert result.cleaned.count() == 0 and result.warning


def test_helper_names_are_refused(spark):
    with pytest.raises(ValueError, match="_gm_"):
        g.clean(spark.createDataFrame([(1,)], "_gm_key int"))
