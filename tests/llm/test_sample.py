from gristmill.llm import common


def test_long_texts_and_copies_do_not_end_a_sample(spark):
    rows = [(f"long {i} " + "x" * 5_000, "a") for i in range(200)] + [(f"t{i}", "a") for i in range(100)] + [("y" * 9_000, "b"), ("z" * 8_000, "b")]
    rows += [("copy", "c")] * 20_000 + [(f"u{i}", "c") for i in range(100)]
    df = spark.createDataFrame(rows, "text string, label string")
    got = common.bounded_sample(common.labelled(df, df["text"], df["label"]), df, 60, 9_000)
    assert sum(v == "a" for _, v in got) == 60 and all(len(t) < 10 for t, v in got if v == "a")
    assert [len(t) for t, v in got if v == "b"] == [8_000]
    assert sum(v == "c" for _, v in got) == 60
