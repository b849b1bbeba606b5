"""A corpus from documents: toxic ones out, repeated runs of lines and near-duplicates out, benchmarks out, packed.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes each result as Parquet to the shared
folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import common, decontaminate, linededup, minhash, packing, queries, toxicity

#: Near-duplicates share so many of their shingles of five words; op10's SQL asks for 85 instead.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. It learns from the labels of the given documents."""
    return toxicity.without_toxic(docs, queries.fitted_toxicity(spark, docs, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; those of which nothing is left go. n_chars is that of the new text."""
    cut = linededup.dedup_passages(docs)
    left = cut.where((F.col("n_cut") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs, NEAR_PERCENT)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark items."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.without(docs, found.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: The stages hold a trained classifier and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last."""
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
