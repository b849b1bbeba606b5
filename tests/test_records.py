import csv
import io
import json
import random

import pytest

import gristmill as g
from gristmill.sources import records
from gristmill.sources.tables import read_json


@pytest.fixture
def small_splits(spark):
    """Files in splits of 300 bytes."""
    changed = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "50"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


CELLS = ["a", "", '5" pipe', "x,y", "two\nlines", 'q"uo"te', "\n\n\n", '"', '""', "a\r\nb", '\n"\n', ',"x', "é" * 30, 'z"']
STRAY = '\n5" pipe,b" c\nzz"z,""'  # quotes within fields that have none around them


@pytest.mark.parametrize("seed", range(4))
def test_csv_records_equal_a_whole_reader(spark, tmp_path, small_splits, seed):
    rng, wanted = random.Random(seed), {}
    for name in ("a.csv", "b.csv"):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        for _ in range(rng.randrange(1, 80)):
            writer.writerow([rng.choice(CELLS) for _ in range(rng.randrange(1, 4))])
        wanted[name] = out.getvalue() + (STRAY if seed % 2 else "")
        (tmp_path / name).write_text(wanted[name], newline="")
    lines = records.pieces(spark, [f"{tmp_path}/{n}" for n in wanted], "\n")
    assert lines.rdd.getNumPartitions() > 2
    got = sorted((r.file.split("/")[-1], r.record_number, r.record) for r in records.csv_records(lines).collect())
    for name, text in wanted.items():
        own = [r for n, _, r in got if n == name]
        assert [k for n, k, _ in got if n == name] == list(range(1, len(own) + 1))
        rows = [next(csv.reader(io.StringIO(r, newline="")), []) for r in own]
        assert rows == list(csv.reader(io.StringIO(text, newline="")))


def test_one_file_of_several_splits_is_read_by_as_many_tasks(spark, tmp_path, small_splits):
    text = "no,note,kind\n" + "".join(f'{k},"line one\nline, two of {k}",x\n' for k in range(40))
    path = tmp_path / "one.csv"
    path.write_text(text[:1150])
    path.write_text(text[: text[:1150].rindex("\n", 0, text.rindex(",x\n", 0, 1150) + 3) + 1])
    assert records.pieces(spark, str(path), "\n").rdd.getNumPartitions() >= 4
    spark.sparkContext.setJobGroup("records", "read")
    table = g.read_csv(spark, str(path), multi_line=True)
    rows = [tuple(r) for r in table.df.orderBy("_row").select("no", "note", "kind").collect()]
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("records") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("other", "")
    assert max(s.numTasks for s in stages if s) >= 4
    assert rows == [(k, f"line one\nline, two of {k}", "x") for k in range(len(rows))] and len(rows) > 20
    assert table.malformed_count == 0


def test_headers_with_breaks_several_headers_and_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"long\nname"\n\n1,"x\ny"\n2,a,b\n3,c\n')
    (tmp_path / "b.csv").write_text('"long\nname",id\n"u\nv",4\nw,5,"6\n7"\n')
    table = g.read_csv(spark, [f"{tmp_path}/b.csv", f"{tmp_path}/a.csv"], multi_line=True)
    assert [(r["id"], r["long\nname"]) for r in table.df.orderBy("_row").collect()] == [(1, "x\ny"), (3, "c"), (4, "u\nv")]
    got = sorted((r["file"][-5:], r["line_number"], r["line"]) for r in table.malformed.collect())
    assert got == [("a.csv", 4, "2,a,b"), ("b.csv", 3, 'w,5,"6\n7"')]


def test_unclosed_quotes_and_files_without_any(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never closed"):
        g.read_csv(spark, f"{tmp_path}/open.csv", multi_line=True)
    (tmp_path / "plain.csv").write_text('a,b\n1,"x"\n2,y 5"\n')
    assert [(r.a, r.b) for r in g.read_csv(spark, f"{tmp_path}/plain.csv", multi_line=True).df.collect()] == [(1, "x"), (2, 'y 5"')]
    (tmp_path / "latin.csv").write_bytes('a,b\n1,"ü\nß"\n'.encode("latin-1"))
    table = g.read_csv(spark, f"{tmp_path}/latin.csv", multi_line=True)
    assert table.df.first()["b"] == "ü\nß" and table.encoding_note


def test_long_quoted_fields_do_not_nest_matches(spark, tmp_path):
    long = 'x""' * 50_000
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}"\n2,"{long}",3\n')
    table = g.read_csv(spark, f"{tmp_path}/long.csv")
    assert table.df.count() == 1 and table.malformed_count == 1
    (tmp_path / "broken.csv").write_text(f'a,b\n1,"{long}\n{long}"\n')
    assert len(g.read_csv(spark, f"{tmp_path}/broken.csv", multi_line=True).df.first()["b"]) == 2 * 100_000 + 1


def value(rng, deep=True):
    flat = [1, None, True, "x", "a}b", "{[", ']"\\', "\\", 'q"', "é}\n{", 1.5]
    return rng.choice([*flat, {"n": rng.choice(["}", '{"']), "m": [1, {"z": []}]}, [{"a": "}"}, []]] if deep else flat)


@pytest.mark.parametrize("seed", range(3))
def test_json_arrays_equal_a_whole_reader(spark, tmp_path, small_splits, seed):
    rng, wanted = random.Random(seed), []
    for name in ("a.json", "b.json"):
        rows = [{f"c{j}": value(rng) for j in range(rng.randrange(5))} for _ in range(rng.randrange(50))]
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 4]))
        (tmp_path / name).write_text(rng.choice(["", "﻿", "\n "]) + text + rng.choice(["", "\n"]))
        wanted += [(name, i + 1, r) for i, r in enumerate(rows)]
    found = records.json_array_records(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"])
    got = sorted(((r.file.split("/")[-1], r.record_number, json.loads(r.record)) for r in found.collect()), key=lambda r: r[:2])
    assert got == wanted


def test_json_of_one_record_and_long_first_records(spark, tmp_path, small_splits):
    (tmp_path / "one.json").write_text('{"b": 1, "a": "x"}')
    assert [tuple(r)[:2] for r in read_json(spark, f"{tmp_path}/one.json").collect()] == [(1, "x")]
    first = {"z": [{"k": i, "t": "}" * 3} for i in range(6000)], "b": 1, "a": 2}
    (tmp_path / "two.json").write_text(json.dumps([first, {"a": 3, "c": "4"}]))
    df = read_json(spark, f"{tmp_path}/two.json")
    assert df.columns == ["z", "b", "a", "c", "_row"]
    assert [(len(r.z or []), r.b, r.a, r.c) for r in df.orderBy("_row").collect()] == [(6000, 1, 2, None), (0, None, 3, 4)]
    (tmp_path / "none.json").write_text("[ ]")
    with pytest.raises(ValueError):
        read_json(spark, f"{tmp_path}/none.json")
