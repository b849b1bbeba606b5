import pytest

from gristmill.naming import col
from gristmill.operators import date_texts, metrics
from gristmill.operators.date_texts import DateTexts

TEXTS = ["01/02/2024", "2024-01-02", "3 Mar 2024 4:05 pm", "no date", None, "31/12/2023", "2024-13-45", "5 of june 1999"]


def built(frame, monkeypatch, small):
    if not small:
        monkeypatch.setattr(date_texts, "is_worth_it", lambda facts: False)
    df = frame([(t, t) for t in TEXTS * 3], "a string, b string")
    facts = {n: {"date_kinds": 8, "other_bytes": 100} for n in ("a", "b")}
    return df, DateTexts(df, {n: col(n) for n in ("a", "b")}, facts)


@pytest.mark.parametrize("small", [True, False])
def test_distinct_texts_give_what_rows_give(frame, rows_of, monkeypatch, small):
    df, texts = built(frame, monkeypatch, small)
    assert texts.counts("a") == texts.counts("b") == {"parsed": 15, "rewritten": 12}
    rewritten = rows_of(texts.rewrite(df, ["a"]).select("a", "b", "_row"))
    wanted = ["2024-01-02", "2024-01-02", "2024-03-03", "no date", None, "2023-12-31", "2024-13-45", "1999-06-05"]
    assert rewritten == list(zip(wanted * 3, TEXTS * 3))
    moments = [None if r[0] is None else str(r[0]) for r in rows_of(texts.with_moment(df, "b", "at").select("at", "_row"))]
    assert moments[:8] == ["2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-03-03 16:05:00", None, None, "2023-12-31 00:00:00", None, "1999-06-05 00:00:00"]


def test_a_column_of_many_texts_is_parsed_row_by_row(spark, tiny_limits):
    rows = [(f"2024-01-{d:02d} 00:{m:02d}:00", d) for d in range(1, 29) for m in range(3)]
    df = spark.createDataFrame(rows, "at string, x int")
    found = metrics.Dates(df)
    assert found.columns == ["at"] and found.facts["at"]["parsed"] == len(rows)
    plan = found.texts.with_moment(df, "at", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
