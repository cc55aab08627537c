"""The corpus pipeline: documents to packed training sequences.

Each stage works on all rows its predecessor kept; its result is written as Parquet
to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import lines, mixing, packing, simhash, toxicity
from ledgerloom.llm.common import fresh, quoted, table, written
from ledgerloom.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    It is fitted on the labelled rows of the input tables, as ``op1`` fits it.
    """
    ship(spark)
    train = F.crc32(F.col("_id").cast("string")) % 5 != 0
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=train)
    (score,) = fresh(docs.columns, "_score")
    return toxicity.score_frame(docs, model, score_col=score).where(F.col(score) < 0.5).select(*map(quoted, docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs."""
    return lines.kept_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    return simhash.representatives(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_of_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_each_group),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are not SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
