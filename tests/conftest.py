import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture
def frame(spark):
    """A table with rows in the given order."""

    def make(rows, schema):
        numbered = [(*(r if isinstance(r, tuple) else (r,)), i) for i, r in enumerate(rows)]
        return spark.createDataFrame(numbered, f"{schema}, _row bigint")

    return make


@pytest.fixture
def rows_of():
    """Rows as tuples in row order, without the order key."""

    def read(df):
        columns = [c for c in df.columns if c != "_row"]
        ordered = df.orderBy("_row") if "_row" in df.columns else df
        return [tuple(r[c] for c in columns) for r in ordered.collect()]

    return read


@pytest.fixture
def tiny_limits(monkeypatch):
    """Treat small test tables as if they were large: nothing is broadcast, few rows make a hot key."""
    from gristmill.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
