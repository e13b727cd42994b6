"""Text records as files that are named by their key: a Spark data source that commits in two phases.

Every task writes its records into a folder of its own attempt. Only when all tasks are done are the files of the
attempts that count moved to their names, so a task that fails or runs twice changes no record. The folders are
moved by tasks again, side by side. A task that outlives a failed write may leave its hidden folder, which nothing reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from marginalia.sources.files import scan_text_keys
from marginalia.sources.tables import insert_new, overwrite_by_key

#: Bytes of a file name that file systems take at most.
NAME_BYTES = 255
#: Files that one process moves at once.
MOVES = 16
#: The file that names the folders to be moved.
COMMITTED = "_committed"


def _file_system(path: str):
    """The pyarrow file system of a path and the path in it."""
    from pyarrow import fs

    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)


def checked_name(key: str | None) -> str:
    if not key or "/" in key or "\0" in key or key in (".", "..") or key.startswith(("_", ".")):
        raise ValueError(f"not a file name that can be read back: {key!r}")
    if len(key.encode()) > NAME_BYTES:
        raise ValueError(f"a file name of more than {NAME_BYTES} bytes: {key!r}")
    return key


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def move_records(path: str, folder: str) -> None:
    """Move the files of `folder` to their names in `path`; what has been moved already is no longer there."""
    from pyarrow import fs

    system, root = _file_system(path)

    def move(source: str) -> None:
        target = f"{root}/{source.rsplit('/', 1)[1]}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            system.delete_file(target)
        system.move(source, target)

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, [info.path for info in system.get_file_info(fs.FileSelector(folder))]))


class RecordWriter(DataSourceWriter):
    """With `staging`, the name of a hidden folder, the caller moves the folders that `commit` writes down there."""

    def __init__(self, path: str, staging: str | None = None) -> None:
        self.path = path
        self.listed = staging is not None
        self.staging = staging or f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, root = _file_system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files = 0
        for row in iterator:
            with system.open_output_stream(f"{folder}/{checked_name(row.key)}") as out:
                out.write((row.content or "").encode())
            files += 1
        return Attempt(folder, files)

    def commit(self, messages: list[Attempt | None]) -> None:
        folders = [message.folder for message in messages if message is not None and message.files]
        if self.listed:
            system, root = _file_system(self.path)
            system.create_dir(f"{root}/{self.staging}", recursive=True)
            with system.open_output_stream(f"{root}/{self.staging}/{COMMITTED}") as out:
                out.write("\n".join(folders).encode())
            return
        for folder in folders:
            move_records(self.path, folder)
        _clean(self.path, self.staging)

    def abort(self, messages: list[Attempt | None]) -> None:
        _clean(self.path, self.staging)


def _clean(path: str, staging: str) -> None:
    from pyarrow import fs

    system, root = _file_system(path)
    if system.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
        system.delete_dir(f"{root}/{staging}")


class RecordFiles(DataSource):
    """Rows of (key, content) as files in `path`; a file that is there already is replaced.

    A null content is an empty file; Spark's readers, `scan_text_corpus` among them, give no row for it.
    """

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "key string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("record files are replaced one by one; use the append mode")
        return RecordWriter(self.options["path"], self.options.get("staging"))


def _write(records: DataFrame, path: str) -> None:
    spark = records.sparkSession
    spark.dataSource.register(RecordFiles)
    staging = f"_staging-{uuid.uuid4().hex}"
    try:
        records.select("key", "content").write.format("record_files").mode("append").option("staging", staging).save(path)
        system, root = _file_system(path)
        with system.open_input_stream(f"{root}/{staging}/{COMMITTED}") as listed:
            folders = listed.read().decode().splitlines()
        if folders:
            spark.sparkContext.parallelize(folders, len(folders)).foreach(lambda folder: move_records(path, folder))
    finally:
        _clean(path, staging)


def write_records(records: DataFrame, path: str, order: Column) -> None:
    """Write (key, content, ...) as one file per key; of a repeated key the last by `order` counts, also over older files."""
    _write(overwrite_by_key(records, "key", order), path)


def insert_records(records: DataFrame, path: str, order: Column) -> None:
    """Write only records whose key has no file yet; of a repeated key the first by `order` counts."""
    _write(insert_new(_present(records.sparkSession, path), records, "key", order), path)


def _present(spark: SparkSession, path: str) -> DataFrame:
    try:
        return scan_text_keys(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string")
