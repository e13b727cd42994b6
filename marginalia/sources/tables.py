"""Keyed Parquet tables: insert-if-absent, last-write-wins, snapshots, vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import staged
from marginalia.sources.versions import drop_folder, newest, publish, versions


def _one_per_key(batch: DataFrame, key: str, order: Column, latest: bool) -> DataFrame:
    """One row per key by `order`, as an aggregate: a hot key shrinks before the shuffle."""
    others = [F.col(c) for c in batch.columns if c != key]
    pick = F.max_by if latest else F.min_by
    kept = batch.groupBy(key).agg(pick(F.struct(*others), order).alias("_row"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in batch.columns])


def first_by_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    return _one_per_key(batch, key, order, latest=False)


def overwrite_by_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Within a batch the last write of a key wins."""
    return _one_per_key(batch, key, order, latest=True)


def latest_by_key(table: DataFrame, key: str, order: Column) -> DataFrame:
    """`overwrite_by_key` for wide rows of which few repeat a key.

    Keys are counted alone; only rows of repeated keys are shuffled, and the others stay where they are
    if the repeated keys are few enough for Spark to broadcast. Rows with a NULL key pass. Without repeated keys
    the table is left as it is, so that whoever reads it does not read it once for each of the two kinds.
    """
    repeated = staged(table.groupBy(key).count().where(F.col("count") > 1).where(F.col(key).isNotNull()).select(key), "repeated-keys")
    if repeated.isEmpty():
        return table
    once = table.join(repeated, key, "left_anti")
    return once.unionByName(overwrite_by_key(table.join(repeated, key, "left_semi"), key, order))


def insert_new(target: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of `batch` to append: keys absent from `target`, first one of a repeated key.

    A NULL key cannot be told from one that is stored, so such rows are not appended. Only keys of `target` are read. They are first cut down to those of the batch, so that a
    small batch is broadcast to a large target rather than the target being shuffled.
    """
    fresh = first_by_key(batch.where(F.col(key).isNotNull()), key, order)
    taken = target.select(key).join(fresh.select(key), key, "left_semi")
    return fresh.join(taken, key, "left_anti")


def append_new(spark: SparkSession, path: str, batch: DataFrame, key: str, order: Column) -> None:
    """`insert_new` against the Parquet table at `path`, appended in place.

    Existing files are never rewritten; a table that does not exist yet is created.
    """
    try:
        target = spark.read.parquet(path)
    except AnalysisException as error:
        # No folder yet, or one in which no file has been written yet.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        first_by_key(batch.where(F.col(key).isNotNull()), key, order).write.mode("append").parquet(path)
        return
    insert_new(target, batch, key, order).write.mode("append").parquet(path)


def replace_snapshot(snapshot: DataFrame, path: str, section: str = "section", keep: int = 2) -> None:
    """Write `snapshot`, one folder per section, as the new version of the table at `path`.

    It is written beside the current version and then switched to, so a write that fails leaves that one
    readable, and `snapshot` may be made from it. The last `keep` versions stay for readers that have begun.
    """
    spark = snapshot.sparkSession
    publish(spark, path, lambda folder, _: snapshot.write.partitionBy(section).parquet(folder))
    for old in versions(spark, path)[:-keep]:
        drop_folder(spark, old.folder)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version of a snapshot; empty before the first one."""
    found = newest(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Store (key, vec[, ...]) with `vec` as ARRAY<FLOAT>."""
    vectors.withColumn("vec", F.col("vec").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Store the (key, my_key, sim) rows that `cosine_pairs` emits."""
    pairs.write.mode("overwrite").parquet(path)
