"""Text sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from math import ceil

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import strings as S
from marginalia.session import staged

#: Tasks for each core where Spark would choose by size alone, and parts of a large directory that are one task at most.
TASKS = 4
PARTS = 64
#: Files of a directory that Spark lists on the driver at most. It keeps more than a kilobyte for each of them there.
LISTED = 10_000
#: Files of a larger directory that are one task, names that are listed and bytes of contents that are handed over together.
FILES = 2048
NAMES = 10_000
BATCH_BYTES = 4 * 1024 * 1024


def _decoded_file_name():
    # The metadata column is percent-encoded but leaves "+" alone, which url_decode would not.
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder of the local or a shared file system; None for other stores, patterns and no folder."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target = fs.Path(path)
    if (target.toUri().getScheme() or fs.FileSystem.getDefaultUri(conf).getScheme()) != "file":
        return None
    plain = target.getFileSystem(conf).makeQualified(target).toUri().getPath()
    return plain if os.path.isdir(plain) else None


def _record_names(folder: str) -> Iterator[str]:
    """The names of the `*.txt` directly in `folder`, without those that Spark's readers take for hidden."""
    with os.scandir(folder) as entries:
        for entry in entries:
            name = entry.name
            hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
            if name.endswith(".txt") and not hidden and entry.is_file():
                yield name


def _large_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder with more than `LISTED` records, of which no more are looked at."""
    folder = _local_folder(spark, path)
    return folder if folder and sum(1 for _ in islice(_record_names(folder), LISTED + 1)) > LISTED else None


def _opened_by_tasks(spark: SparkSession, folder: str, contents: bool) -> DataFrame:
    """(key, content, modified) of a large folder, or its keys alone; the driver sees no file.

    One task lists the names and writes them as a table, which is dealt out to tasks that open the files. Runs a job.
    Empty files give no row, as with Spark's readers.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        if sum(batch.num_rows for batch in batches):
            found = _record_names(folder)
            while some := list(islice(found, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["key"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([os.stat(f"{folder}/{key}").st_size > 0 for key in batch.column(0).to_pylist()], pa.bool_()))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("content", pa.binary()), ("millis", pa.int64())])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, size = [], 0
        for batch in batches:
            for key in batch.column(0).to_pylist():
                with open(f"{folder}/{key}", "rb") as file:
                    content, millis = file.read(), os.fstat(file.fileno()).st_mtime_ns // 1_000_000
                if content and rows and size + len(content) > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
                if content:
                    rows.append((key, content, millis))
                    size += len(content)
        if rows:
            yield batch_of(rows)

    listed = staged(spark.range(0, 1, 1, 1).mapInArrow(names, "key string"), "record-names")
    dealt = listed.repartition(max(TASKS * spark.sparkContext.defaultParallelism, ceil(listed.count() / FILES)))
    if not contents:
        return dealt.mapInArrow(keys, "key string")
    return dealt.mapInArrow(records, "key string, content binary, millis bigint").select(
        "key", _text(F.col("content")).alias("content"), F.timestamp_millis("millis").alias("modified")
    )


def _text(content: Column) -> Column:
    return S.universal_newlines(content.cast("string"))


def scan_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Each `*.txt` directly in `path` as one row: (key, content, modified).

    Newlines are translated as in text mode. Sub-folders are not entered. The files are read as bytes, which costs
    a fraction of what the text reader sets up for every file. Spark deals small files out a few to a task; of a
    large directory many such parts are one task. A local or shared directory of more than `LISTED` files is listed
    and opened by tasks, as Spark would hold all its files in the driver's memory.
    """
    if folder := _large_folder(spark, path):
        return _opened_by_tasks(spark, folder, contents=True)
    corpus = (
        spark.read.format("binaryFile").load(path, pathGlobFilter="*.txt", recursiveFileLookup=False)
        .select(
            _decoded_file_name().alias("key"),
            _text(F.col("content")).alias("content"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    parts, enough = corpus.select("key").rdd.getNumPartitions(), TASKS * spark.sparkContext.defaultParallelism
    return corpus.coalesce(max(enough, ceil(parts / PARTS))) if parts > enough else corpus


def scan_text_keys(spark: SparkSession, path: str) -> DataFrame:
    """The keys of `scan_text_corpus`, for which no file is opened."""
    if folder := _large_folder(spark, path):
        return _opened_by_tasks(spark, folder, contents=False)
    return scan_text_corpus(spark, path).select("key")


def scan_name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, stripped, blanks dropped; a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string")
    return lines.select(S.strip(F.col("value")).alias("name")).where(F.col("name") != "")


def write_text_corpus(records: DataFrame, path: str) -> None:
    """Write each row's `content` as its own text file in `path`.

    Spark names the files, so the record key must be part of the content.
    """
    (
        records.select(F.regexp_replace("content", r"\n\z", "").alias("value"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def report_sink(reports: DataFrame, path: str) -> None:
    """Write (run_date, md), one folder per day; a rerun replaces only its own days.

    The days are dealt to a fixed number of tasks: the folders take the time, and short texts would be few tasks. They
    are dealt by a hash, as Spark drops a repartitioning that equals the one its input already has.
    """
    (
        # The text writer adds the final line break itself.
        reports.select(F.regexp_replace("md", r"\n\z", "").alias("value"), F.col("run_date").cast("string"))
        .repartition(TASKS * reports.sparkSession.sparkContext.defaultParallelism, F.xxhash64("run_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .text(path)
    )


def report_parts_sink(chunks: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """Write (run_date, section_no, rank, chunk) as one folder per day, whose files in order of name are the report.

    The chunks are dealt to tasks by ranges and sorted there, so a day may be any number of files. `days`
    (run_date) names days that are written although they may have no chunk; a rerun replaces only its own days.
    """
    order = ["run_date", "section_no", "rank"]
    rows = chunks.select(F.col("run_date").cast("string").alias("run_date"), "section_no", "rank", "chunk")
    if days is not None:
        empty = days.select(F.col("run_date").cast("string").alias("run_date")).distinct()
        empty = empty.join(rows.select("run_date").distinct(), "run_date", "left_anti")
        rows = rows.unionByName(empty.withColumn("chunk", F.lit("")), allowMissingColumns=True)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        # The text writer adds the final line break of a chunk itself.
        ordered.select(F.regexp_replace("chunk", r"\n\z", "").alias("value"), "run_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .text(path)
    )


def scan_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_date, line_no, line) of reports of any number of files, lines counted from 0 over a day's files.

    Only the number of lines of each file meets in one place. A file is what one task wrote.
    """
    parts = (
        spark.read.schema("value string, run_date string")
        .text(path, wholetext=True)
        .select("run_date", F.col("_metadata.file_name").alias("part"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
    )
    earlier = Window.partitionBy("run_date").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select("run_date", "part", F.size("lines").alias("n"))
    starts = sizes.select("run_date", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = parts.join(starts, ["run_date", "part"]).select("run_date", "start", F.posexplode("lines").alias("pos", "line"))
    return numbered.select("run_date", (F.col("start") + F.col("pos")).alias("line_no"), "line")


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as (run_date STRING, md, modified); the date stays as it is spelled."""
    return (
        spark.read.schema("value string, run_date string")
        .text(path, wholetext=True)
        .select(
            "run_date",
            S.universal_newlines(F.col("value")).alias("md"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def export_sink(exports: DataFrame, path: str) -> None:
    """Write one text file per exported link list."""
    exports.select(F.col("links").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
