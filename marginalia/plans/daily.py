"""The whole daily job: refresh the reader's own vectors if needed, recommend, report, remember."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.state import corpus_fingerprint, model_fingerprint, rebuild_decision
from marginalia.options import ModelOptions, RecommendOptions
from marginalia.plans.recommend import daily_report, recommend
from marginalia.sources.files import report_sink
from marginalia.sources.vector_store import VectorStore, refresh
from marginalia.sources.versions import newest, publish

STATE = "corpus_id string, content_hash string, fingerprint string, vectors bigint"


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """What the last finished run left: one row per own corpus; nothing before the first run."""
    found = newest(spark, f"{folder}/state", STATE)
    return spark.createDataFrame([], STATE) if found is None else found


def vector_store(folder: str) -> VectorStore:
    return VectorStore(f"{folder}/vectors")


def refresh_vectors(
    own: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], model: ModelOptions, check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(vectors, state row to write) of the own corpus (key, content).

    Only what changed is encoded, and written as a change of the vector store. The state names the version
    of the store it was made with, so that a run that fails leaves the vectors its state points to.
    """
    spark = own.sparkSession
    store = vector_store(folder)
    fingerprint = model_fingerprint(model)
    current = corpus_fingerprint(own.withColumn("corpus_id", F.lit("own")))
    last = read_state(spark, folder)
    found = last.first()
    decision = rebuild_decision(current, last, last.select("corpus_id"), fingerprint, check).first()
    if found is not None and (decision is None or not decision.rebuild):
        return store.read(spark, found.vectors), last
    row = current.first()
    version = refresh(store, own, encode, fingerprint)
    made = [("own", row.content_hash if row else None, fingerprint, version)]
    return store.read(spark, version), spark.createDataFrame(made, STATE)


def daily_job(
    papers: DataFrame,
    own: DataFrame,
    folder: str,
    black: DataFrame,
    white: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    run_date: str,
    options: RecommendOptions = RecommendOptions(),
    model: ModelOptions = ModelOptions("hashing"),
    check: bool = True,
) -> None:
    """One day's run in `folder`: vectors, then `reports/run_date=...`, then the state, last.

    Rerunning a day replaces its report, also by an empty one, and leaves the other days alone.
    """
    vectors, state = refresh_vectors(own, folder, encode, model, check)
    recs = recommend(papers, vectors.select("key", "vec"), black, white, encode, options)
    report_sink(daily_report(recs, F.lit(run_date)), f"{folder}/reports")
    spark = papers.sparkSession
    rows = spark.createDataFrame(state.collect(), STATE)  # one row per own corpus
    publish(spark, f"{folder}/state", lambda version, _: rows.coalesce(1).write.parquet(version))
