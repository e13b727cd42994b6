"""A training-data pipeline: five stages, each written as Parquet and read again by the next.

Quality classifier, MinHash near-duplicates, secrets, mixing to target weights, packing. Every stage
works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import compression, dart, mixing, packing, secret_scan
from marginalia.llm.common import table
from marginalia.llm.queries import vocabulary
from marginalia.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose score is below this go; it is the threshold of the classifier's `predicted`.
KEEP_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on labelled rows of `docs`, accepts."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    return compression.accepted_rows(docs, model, KEEP_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near-duplicates."""
    return dart.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as their source's target asks; a document may come up to twice."""
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every row, with their ids."""
    return packing.power_of_two_pieces(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixed", mixed),
    ("packed", packed),
]

#: None: neither compressed sizes nor vocabularies can be stated in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Intermediate tables go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
