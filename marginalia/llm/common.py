"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator works on at once; results do not depend on it.
SLICE = 1000
#: A word, where a contract names it so.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has both; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fresh_prefix(columns: list[str]) -> str:
    """A prefix that no column begins with, for columns that an operator adds for itself; case does not tell names apart."""
    prefix = "_x_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def give_back_memory() -> None:
    """Return what this process has freed, but its allocators keep, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `work` to slices of the Arrow batches of `frame`; it may give a batch of any length, or none.

    A slice has at most SLICE rows, so what a task holds beside one Arrow batch stays small. At its end
    the task gives freed memory back, as Python workers live on for other tasks and queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    if (out := work(batch.slice(start, SLICE))) is not None:
                        yield out
        finally:
            give_back_memory()

    return frame.mapInArrow(run, schema)


def id_fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def labelled_ids(labels: DataFrame, column: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """At most `per_class` ids of either label outside the held-out fold, as (doc_id, label, weight).

    `weight` restores the shares that the classes have over all labels: that of the class cut less is 1.
    The bound makes the result safe to broadcast whatever the size of `labels`. Which ids are
    taken depends on a hash of the id alone. Ids labelled both 0 and 1 are left out.
    """
    clean = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("high"))
        .where((F.col("label") == F.col("high")) & (id_fold(modulus) != held_out))
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    sizes = {r.label: r["count"] for r in clean.groupBy("label").count().collect()}
    cut = {side: max(sizes[side] / per_class, 1.0) for side in sizes}
    weight = {side: cut[side] / min(cut.values()) if side in cut else 1.0 for side in (0, 1)}
    sides = [
        clean.where(F.col("label") == side).orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(weight[side]))
        for side in (0, 1)
    ]
    return sides[0].unionByName(sides[1])


def fit_logistic(
    features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 100, counts: np.ndarray | None = None
) -> np.ndarray:
    """Weights of a ridge logistic regression; the intercept comes last. A row counts as `counts` rows, else as one.

    Newton steps over standardised features, each halved until the penalised loss falls, so that
    separable classes and correlated features cannot make it diverge.
    """
    if not len(features):
        return np.zeros(features.shape[1] + 1)
    counts = np.ones(len(features)) if counts is None else counts
    size_of_all = counts.sum()
    middle = counts @ features / size_of_all
    spread = np.sqrt(counts @ (features - middle) ** 2 / size_of_all)
    spread = np.where(spread > 1e-12, spread, 1.0)
    x = np.hstack([(features - middle) / spread, np.ones((len(features), 1))])
    penalty = np.full(x.shape[1], ridge * size_of_all)
    penalty[-1] = 1e-9 * size_of_all

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(counts @ np.logaddexp(0, z) - (counts * labels) @ z + 0.5 * (penalty * w) @ w)

    weights = np.zeros(x.shape[1])
    now = loss(weights)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (counts * (labels - p)) - penalty * weights
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        size = 1.0
        while size > 1e-6 and (after := loss(weights + size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - after < 1e-9 * max(now, 1.0):
            break
        weights, now = weights + size * step, after
    raw = weights[:-1] / spread
    return np.append(raw, weights[-1] - raw @ middle)


def logistic(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]
