import random

import pytest
from pyspark.sql import functions as F

CLASHING = ("row", "key", "sub", "n", "own", "own_id", "text_key", "h", "value", "grp", "pos")


@pytest.fixture(scope="session")
def documents(spark):
    """A table like documents from (doc_id, text) pairs, with null and clashing columns besides."""

    def make(rows):
        df = spark.createDataFrame([(i, t, None, "s") for i, t in rows], "doc_id long, text string, lang string, source string")
        return df.withColumns({c: F.lit(None).cast("string") for c in CLASHING})

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of made-up words from a seed."""

    def make(words, seed, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))

    return make


ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n\t "), (4, "Ünïcode wörds! ünd mehr."), (5, "same"), (6, "same"), (6, "same"), (None, "same")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
