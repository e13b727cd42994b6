"""Versions of a table: a new one is written beside the old one, then one pointer row switches to it.

`path` holds a folder per version and a ledger, to which every finished version appends one row. Readers
resolve the newest row, so a write that fails leaves them what they had. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LEDGER = "number bigint, kind string, folder string, n_rows bigint"


@dataclass(frozen=True)
class Version:
    number: int
    kind: str
    folder: str
    n_rows: int


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions of the table at `path`, oldest first; there are as many as there were writes."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{path}/ledger").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((Version(r.number, r.kind, f"{path}/{r.folder}", r.n_rows) for r in rows), key=lambda v: v.number)


def publish(spark: SparkSession, path: str, write: Callable[[str, int], None], kind: str = "whole") -> Version:
    """Let `write` fill a new folder, given its number, and switch to it once it is there."""
    known = versions(spark, path)
    number = known[-1].number + 1 if known else 1
    folder = f"{kind}-{number:08d}-{uuid.uuid4().hex[:8]}"
    try:
        write(f"{path}/{folder}", number)
    except Exception:
        drop_folder(spark, f"{path}/{folder}")
        raise
    n_rows = spark.read.parquet(f"{path}/{folder}").count()  # answered by the files' footers
    row = spark.createDataFrame([(number, kind, folder, n_rows)], LEDGER)
    row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return Version(number, kind, f"{path}/{folder}", n_rows)


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def newest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The rows of the newest version, or None before the first one."""
    known = versions(spark, path)
    if not known:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(known[-1].folder)
