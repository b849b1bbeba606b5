import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates

TEXTS = [
    "2024-01-05", "01/06/2024", "13/06/2024", "5-6-24", "24-05-06", "99-01-05", "05-99-06", "March 2024",
    "2024 March", "Mar-24", "20240105", "202401", "2024", "2024-03", "03/2024", "2024/3/5", "2024.3.5", "3.5.2024",
    "Jan 8 2024", "Jan 8, 2024", "8 Jan 2024", "8-Jan-2024", "8-Jan-24", "08Jan2024", "January 8th, 2024",
    "8th of January 2024", "Mon, 8 Jan 2024", "Sept 8 2024", "2024-Jan-08", "Jan 8", "may", "2024-02-30",
    "2024-01-05 10:30", "2024-01-05T10:30:00Z", "2024-01-05 10:30:00.123", "1/5/2024 3:04 PM", "2024-01-05 25:00",
    "2024Q1", "2024-13-01", "12/31/1999", "3000-01-01", "1500-01-01", "1.5", "12", "1.2.3", "tbd", "x",
    "2024-01-05 12:15 am", "2024-01-05 12:15 pm", "2024-01-05 13:30 PM", "2024-01-05 10:30:60", "31/4/2024",
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    df = dates.with_days(df, {"day": F.col("s")})
    df = df.withColumn("moment", dates.with_clock(F.col("day"), F.col("s")))
    return {r["s"]: (r["day"], r["moment"]) for r in df.collect()}


@pytest.mark.parametrize("text", TEXTS)
def test_as_pandas_reads_mixed_dates(parsed, text):
    expected = pd.to_datetime(pd.Series([text]), errors="coerce", format="mixed")[0]
    if pd.isna(expected):
        assert parsed[text] == (None, None)
    else:
        moment = expected.replace(tzinfo=None).to_pydatetime()
        assert parsed[text] == (moment.date(), moment)


def test_month_comes_first_unless_it_cannot(parsed):
    assert parsed["01/06/2024"][0] == dt.date(2024, 1, 6)
    assert parsed["13/06/2024"][0] == dt.date(2024, 6, 13)
