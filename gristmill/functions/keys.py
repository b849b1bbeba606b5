"""Fixed-width keys that stand for whole rows in shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["_gm_k1", "_gm_k2"]


def row_key(columns: Sequence[Column]) -> dict[str, Column]:
    """Two independent 64-bit hashes of a row; equal rows, nulls included, share both.

    xxhash64 skips nulls, so the pattern of nulls is hashed along with the values.
    """
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return {
        KEY[0]: F.xxhash64(nulls, *columns),
        KEY[1]: F.xxhash64(F.lit("second"), nulls, *columns),
    }
