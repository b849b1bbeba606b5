from gristmill.llm import common, language

WORDS = {"xx": "alpha beta gamma delta epsilon zeta eta theta", "yy": "один два три четыре пять шесть семь восемь", "zz": "uno dos tres cuatro cinco seis siete ocho"}


def sample(lang, seed, n=8):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_held_out_accuracy(documents, odd_rows):
    model = language.fit([(sample(lang, i), lang) for lang in WORDS for i in range(60)] + [("", "xx"), ("12", "xx"), (None, "yy"), ("x", None)])
    rows = [(i, sample(lang, 1000 + i)) for i, lang in enumerate(list(WORDS) * 30)]
    got = {r.doc_id: r for r in language.identify(documents(rows), model).collect()}
    assert all(got[i].lang_pred == lang for i, lang in enumerate(list(WORDS) * 30))
    odd = language.identify(documents([*odd_rows, (70, "123 !?"), (71, "ÜÜ " * 60_000)]), model).collect()
    assert len(odd) == len(odd_rows) + 2
    by_id = {r.doc_id: r for r in odd}
    assert by_id[70].lang_pred == "und" and by_id[1].lang_pred == "und" and by_id[3].lang_pred == "und"
    assert by_id[71].lang_pred in WORDS and by_id[71].rejected
    assert all(0 <= r.score <= 1 for r in odd)


def test_nothing_learned(documents):
    model = language.fit([])
    assert [r.lang_pred for r in language.identify(documents([(1, "text")]), model).collect()] == ["und"]
    assert language.identify(documents([]), model).count() == 0


def test_sample_is_bounded(spark):
    rows = [("copy", "a")] * 300 + [(f"t{i}", "a") for i in range(400)] + [(f"u{i}", "b") for i in range(5)] + [(None, "a"), ("x", None)]
    def sample_of(rows, per_class, most_bytes):
        df = spark.createDataFrame(rows, "text string, label string")
        return common.bounded_sample(common.labelled(df, df["text"], df["label"]), df, per_class, most_bytes)

    got = sample_of(rows, 50, 10_000)
    assert sum(v == "a" for _, v in got) == 50 and sum(v == "b" for _, v in got) == 5
    assert len(set(got)) == len(got)
    assert sum(len(t) for t, _ in sample_of(rows, 50, 60)) <= 60
    assert sample_of([], 50, 60) == []
