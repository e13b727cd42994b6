"""A keyed table of vectors as a base and changes, so that a small change is a small write.

Vectors of new and changed records, and tombstones of removed ones, are appended as a file of their own. A
reader takes each key from the newest change that names it, else from the base. When the changes have grown
beyond a share of the base, both are written as a new base. Every write is a version beside the others, so
readers of an earlier one are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.state import with_hash
from marginalia.operators.text import compose_text
from marginalia.session import staged
from marginalia.sources.versions import Version, publish, versions

COLUMNS = ["key", "vec", "content_hash", "fingerprint"]
#: Rows of one file of changes.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class VectorStore:
    """(key, vec ARRAY<FLOAT>, content_hash, fingerprint) in `path`; keys are not NULL."""

    path: str
    compact_share: float = 0.2  # rows of changes, as a share of the base, that call for a new base

    def parts(self, spark: SparkSession, upto: int | None = None) -> tuple[Version | None, list[Version]]:
        """The base and the changes after it, as of version `upto` or now."""
        known = [v for v in versions(spark, self.path) if upto is None or v.number <= upto]
        bases = [v for v in known if v.kind == "base"]
        if not bases:
            return None, []
        return bases[-1], [v for v in known if v.number > bases[-1].number]

    def number(self, spark: SparkSession) -> int:
        known = versions(spark, self.path)
        return known[-1].number if known else 0

    def read(self, spark: SparkSession, upto: int | None = None, columns: list[str] = COLUMNS) -> DataFrame | None:
        """The vectors, or None before the first write. Only the changed keys are joined with the base.

        These keys are written first: Spark then knows how few they are and broadcasts them to the base.
        """
        base, changes = self.parts(spark, upto)
        if base is None:
            return None
        old = spark.read.parquet(base.folder).select(*columns)
        if not changes:
            return old
        changed = spark.read.parquet(*(v.folder for v in changes))
        newest = staged(changed.groupBy("key").agg(F.max("number").alias("number")), "changed-keys")
        live = changed.where("NOT removed").select("number", *columns).join(newest, ["key", "number"], "left_semi")
        return old.join(newest, "key", "left_anti").unionByName(live.select(*columns))

    def write_base(self, vectors: DataFrame) -> Version:
        stored = vectors.select(*COLUMNS).withColumn("vec", F.col("vec").cast("array<float>"))
        return publish(vectors.sparkSession, self.path, lambda folder, _: stored.write.parquet(folder), "base")

    def write_changes(self, vectors: DataFrame, removed: DataFrame) -> Version:
        """Append `vectors`, all rows of their keys, and tombstones for the keys of `removed`."""
        spark = vectors.sparkSession
        live = vectors.select(*COLUMNS, F.lit(False).alias("removed")).withColumn("vec", F.col("vec").cast("array<float>"))
        # Encoded in parallel first; then few rows become few files.
        rows = staged(live.unionByName(removed.select("key", F.lit(True).alias("removed")), allowMissingColumns=True), "vector-changes")
        files = max(1, ceil(rows.count() / FILE_ROWS))

        def write(folder: str, number: int) -> None:
            rows.withColumn("number", F.lit(number).cast("bigint")).coalesce(files).write.parquet(folder)

        return publish(spark, self.path, write, "changes")

    def compact(self, spark: SparkSession) -> Version | None:
        """Write a new base if the changes are more than `compact_share` of the old one."""
        base, changes = self.parts(spark)
        if base is None or sum(v.n_rows for v in changes) <= self.compact_share * base.n_rows:
            return None
        return self.write_base(self.read(spark))


def refresh(store: VectorStore, corpus: DataFrame, encode: Callable[[DataFrame], DataFrame], fingerprint: str) -> int:
    """Bring `store` to the state of `corpus` (key, content) with as little encoding and writing as possible.

    A key is touched if its contents are not those stored, or if its vectors were made by another model; a
    missing fingerprint does not tell of another one. All rows of touched keys are encoded, keys that are
    gone become tombstones, and nothing is written if there are none. Rows without a key cannot be stored.
    Returns the number of the version that holds the result; it reads as if everything had been encoded.
    """
    spark = corpus.sparkSession
    hashed = with_hash(corpus.where(F.col("key").isNotNull()))
    made_by = F.lit(fingerprint)
    stored = store.read(spark, columns=["key", "content_hash", "fingerprint"])
    if stored is None:
        return store.write_base(encode(compose_text(hashed)).withColumn("fingerprint", made_by)).number
    digests = staged(hashed.select("key", "content_hash"), "content-hashes")  # the wide corpus is read for it once
    valid = F.coalesce("fingerprint", made_by) == made_by
    had = staged(stored.select("key", F.when(valid, F.col("content_hash")).otherwise(F.lit("")).alias("content_hash")), "stored-hashes")
    on = ["key", "content_hash"]
    touched = digests.join(had, on, "left_anti").select("key").unionByName(had.join(digests, on, "left_anti").select("key"))
    touched = staged(touched.distinct(), "touched-keys")
    if touched.isEmpty():
        return store.number(spark)
    fresh = encode(compose_text(hashed.join(touched, "key", "left_semi"))).withColumn("fingerprint", made_by)
    written = store.write_changes(fresh, touched.join(digests, "key", "left_anti"))
    return (store.compact(spark) or written).number
