"""Record files by key, padded batches of like length, and reports written in order."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import plan_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.catalog.queries import hashing_encoder_factory, hashing_model_factory
from marginalia.operators import report, vectors
from marginalia.sources import files
from marginalia.sources.records import checked_name, insert_records, write_records


def _records(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, content string, n int")


def _found(spark, path):
    return sorted((r.key, r.content) for r in files.scan_text_corpus(spark, path).collect())


def test_record_files_are_written_replaced_and_inserted(spark, tmp_path):
    path = str(tmp_path / "records")
    first = _records(spark, [("a_b c%+é.txt", "1\n"), ("b.txt", "2"), ("b.txt", "3"), ("c.txt", "0")]).repartition(3)
    write_records(first, path, F.col("n"))
    assert _found(spark, path) == [("a_b c%+é.txt", "1\n"), ("b.txt", "3"), ("c.txt", "0")]
    write_records(_records(spark, [("b.txt", "4"), ("d.txt", "5")]), "file://" + path, F.col("n"))
    insert_records(_records(spark, [("b.txt", "6"), ("e.txt", "7"), ("e.txt", "8"), (None, "9")]), path, F.col("n"))
    assert _found(spark, path) == [("a_b c%+é.txt", "1\n"), ("b.txt", "4"), ("c.txt", "0"), ("d.txt", "5"), ("e.txt", "7")]
    assert all(p.suffix == ".txt" for p in (tmp_path / "records").iterdir())
    insert_records(_records(spark, [("x.txt", "1")]), str(tmp_path / "fresh"), F.col("n"))
    assert _found(spark, str(tmp_path / "fresh")) == [("x.txt", "1")]


@pytest.mark.parametrize("bad", ["", "a/b", "..", "_hidden", "x" * 256])
def test_a_task_that_fails_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "records")
    write_records(_records(spark, [("a.txt", "1")]), path, F.col("n"))
    with pytest.raises(PySparkException):
        write_records(_records(spark, [("a.txt", "2"), ("b.txt", "3"), (bad, "4")]).repartition(3, "key"), path, F.col("n"))
    assert _found(spark, path) == [("a.txt", "1")] and [p.name for p in (tmp_path / "records").glob("[!_]*")] == ["a.txt"]
    with pytest.raises(ValueError, match="file name"):
        checked_name(bad)


def test_padded_batches_equal_whole_texts_and_pad_less(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, int(n)))) for i, n in enumerate(rng.geometric(0.02, 300) - 1)]
    texts = spark.createDataFrame(rows, "key int, text string").coalesce(1)
    plain = {r.key: r.vec for r in vectors.embed(texts, hashing_encoder_factory()).collect()}
    got = vectors.embed_padded(texts, hashing_model_factory(), max_tokens=10_000, pool_texts=128).collect()
    assert [r.key for r in got] == [key for key, _ in rows]
    assert all(r.vec == pytest.approx(plain[r.key]) for r in got)
    assert [r.n_tokens for r in got] == [len(text.split()) for _, text in rows]
    sizes = [r.n_tokens for r in got]
    in_order = sum(max(1, *sizes[at : at + 16]) * len(sizes[at : at + 16]) for at in range(0, 300, 16))
    assert sum(sizes) <= sum(r.n_padded for r in got) < 0.5 * in_order
    cut = vectors.embed_padded(texts, hashing_model_factory(), max_tokens=20).collect()
    short = spark.createDataFrame([(key, " ".join(text.split()[:20])) for key, text in rows], "key int, text string")
    whole = {r.key: r.vec for r in vectors.embed(short, hashing_encoder_factory()).collect()}
    assert all(r.vec == pytest.approx(whole[r.key]) and r.n_tokens <= 20 for r in cut)
    assert vectors.embed_padded(texts.where("false"), hashing_model_factory()).count() == 0


def test_ordered_parts_are_the_report(spark, tmp_path):
    rows = [(day, section, rank, f"### [{day} {section} {rank}](u)\n\n---\n\n") for day, sizes in (("d1", (40, 3)), ("d2", (0, 5)), ("d3", (7, 0)))
            for section, n in zip(("Priority", "Other"), sizes, strict=True) for rank in range(1, n + 1)]
    entries = spark.createDataFrame(rows, "run_date string, section string, rank int, entry string").repartition(5)
    whole = {r.run_date: r.md for r in report.assemble_report(entries).collect()}
    chunks = report.ordered_chunks(entries)
    assert "collect_list" not in plan_of(chunks)
    path = str(tmp_path / "parts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.report_parts_sink(chunks, path, spark.createDataFrame([("d1",), ("d4",)], "run_date string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = {}
    for folder in (tmp_path / "parts").glob("run_date=*"):
        parts = sorted(folder.glob("part-*"))
        made[folder.name.removeprefix("run_date=")] = "".join(p.read_text() for p in parts)
        assert folder.name != "run_date=d1" or len(parts) > 1
    assert made == whole | {"d4": "\n"}
    lines = {}
    for r in sorted(files.scan_report_lines(spark, path).collect(), key=lambda r: r.line_no):
        lines.setdefault(r.run_date, []).append(r.line)
        assert r.line_no == len(lines[r.run_date]) - 1
    assert {day: "\n".join(found) + "\n" for day, found in lines.items()} == made
    files.report_parts_sink(chunks.where("run_date = 'd1' AND rank = 1"), path)
    assert sorted(p.name for p in (tmp_path / "parts").glob("run_date=*")) == [f"run_date=d{k}" for k in (1, 2, 3, 4)]


def test_folders_of_records_are_moved_by_tasks(spark, tmp_path, monkeypatch):
    """The driver moves no file, also when a record is replaced, and leaves no hidden folder."""
    from marginalia.sources import records

    def refused(*_):
        raise AssertionError("moved by the driver")

    path, rows = str(tmp_path / "records"), [(f"{k}.txt", str(k)) for k in range(40)]
    for shift in (0, 1):
        batch = _records(spark, [(key, f"{content}+{shift}") for key, content in rows]).repartition(4)
        with monkeypatch.context() as patch:
            patch.setattr(records.RecordWriter, "commit", lambda self, messages, commit=records.RecordWriter.commit: commit(self, messages) if self.listed else refused())
            write_records(batch, path, F.col("n"))
        assert dict(_found(spark, path)) == {key: f"{content}+{shift}" for key, content in rows}
        assert sorted(p.name for p in (tmp_path / "records").iterdir()) == sorted(key for key, _ in rows)
    empty = spark.createDataFrame([], "key string, content string, n int")
    write_records(empty, path, F.col("n"))
    assert len(_found(spark, path)) == 40


def test_records_are_read_as_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\n\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    corpus = files.scan_text_corpus(spark, str(tmp_path))
    assert "binaryFile" in plan_of(corpus) and "Scan text" not in plan_of(corpus)
    assert corpus.select("key", F.hex("content").alias("hex")).collect() == [("a.txt", "EFBBBF780AFF")]


def test_a_directory_is_opened_once(spark, tmp_path):
    from marginalia.operators.vectors import hashing_vectors
    from marginalia.plans.recommend import recommend_records

    rows = [(f"{k}.txt", f"Title: t{k}\nAuthors: Ann B{k}\nAbstract:\nw{k} x\nURL: u\nDate: d\n") for k in range(5)]
    write_records(_records(spark, rows), str(tmp_path / "r"), F.col("n"))
    names = spark.createDataFrame([("Ann B1",)], "name string")
    own = hashing_vectors(spark.createDataFrame([(1, "w2 x")], "key int, text string"))
    found = recommend_records(files.scan_text_corpus(spark, str(tmp_path / "r")), own, names, names.where("false"), hashing_vectors)
    assert "binaryFile" not in plan_of(found)
    assert sorted(r.key for r in found.collect()) == ["0.txt", "2.txt", "3.txt", "4.txt"] and found.orderBy("rank").first().key == "2.txt"


def test_a_large_directory_is_not_a_task_per_few_files(spark, tmp_path):
    for k in range(700):
        (tmp_path / f"{k}.txt").write_text(str(k))
    corpus = files.scan_text_corpus(spark, str(tmp_path))
    assert corpus.rdd.getNumPartitions() == files.TASKS * spark.sparkContext.defaultParallelism
    assert sorted((r.key, r.content) for r in corpus.collect()) == sorted((f"{k}.txt", str(k)) for k in range(700))


def test_short_reports_of_many_days_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    days = spark.range(200).select(F.col("id").cast("string").alias("run_date")).groupBy("run_date").agg(F.lit("x\n").alias("md"))
    with monkeypatch.context() as patch:
        patch.setattr(files, "TASKS", 3)
        spark.conf.set("spark.sql.shuffle.partitions", 3 * spark.sparkContext.defaultParallelism)
        try:
            files.report_sink(days, str(tmp_path / "reports"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    tasks = {p.name.split("-")[1] for p in (tmp_path / "reports").glob("run_date=*/part-*")}
    assert len(tasks) > 8 and files.scan_reports(spark, str(tmp_path / "reports")).where("md = 'x\n'").count() == 200


def test_a_large_directory_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's listing holds every file on the driver; the rows are the same without it."""
    path = tmp_path / "r"
    path.mkdir()
    for k in range(30):
        (path / f"{k} b+c%é.txt").write_bytes(f"x{k}\r\ny\r".encode() + b"\xff")
    for name in ("_hidden.txt", "_a=b.txt", ".dot.txt", "skip.md", "up.TXT"):
        (path / name).write_text("z")
    (path / "empty.txt").write_bytes(b"")
    (path / "folder.txt").mkdir()
    (path / "folder.txt" / "deep.txt").write_text("no")

    def rows(corpus):
        return sorted(tuple(r) for r in corpus.withColumn("content", F.hex("content")).collect())

    small = files.scan_text_corpus(spark, str(path))
    expected = rows(small)
    assert len(expected) == 31 and "binaryFile" in plan_of(small)
    monkeypatch.setattr(files, "LISTED", 10, raising=False)
    monkeypatch.setattr(files, "BATCH_BYTES", 16, raising=False)
    for spelled in (str(path), f"file://{path}", f"file:{path}/"):
        large = files.scan_text_corpus(spark, spelled)
        assert "binaryFile" not in plan_of(large) and large.dtypes == small.dtypes
        assert rows(large) == expected
    assert sorted(r.key for r in files.scan_text_keys(spark, str(path)).collect()) == [key for key, *_ in expected]
    assert rows(files.scan_text_corpus(spark, f"{tmp_path}/[r]")) == expected


def test_records_are_inserted_into_a_large_directory(spark, tmp_path, monkeypatch):
    """The names that are taken are listed by tasks; an empty file is no record, and its name is free."""
    from marginalia.sources import records

    monkeypatch.setattr(files, "LISTED", 10, raising=False)
    path = str(tmp_path / "r")
    write_records(_records(spark, [(f"{k}.txt", f"old {k}") for k in range(20)] + [("empty.txt", None)]), path, F.col("n"))
    assert "binaryFile" not in plan_of(records._present(spark, path))
    insert_records(_records(spark, [(f"{k}.txt", f"new {k}") for k in range(15, 25)] + [("empty.txt", "e")]), path, F.col("n"))
    assert dict(_found(spark, path)) == {f"{k}.txt": f"{'old' if k < 20 else 'new'} {k}" for k in range(25)} | {"empty.txt": "e"}


def test_a_recommendation_from_a_large_directory_is_the_same(spark, tmp_path, monkeypatch):
    from marginalia.operators.vectors import hashing_vectors
    from marginalia.plans.recommend import recommend_records

    rows = [(f"{k}.txt", f"Title: t{k}\nAuthors: Ann B{k}\nAbstract:\nw{k} x\nURL: u\nDate: d\n") for k in range(20)]
    write_records(_records(spark, rows), str(tmp_path / "r"), F.col("n"))
    names = spark.createDataFrame([("Ann B1",), ("Ann B7",)], "name string")
    own = hashing_vectors(spark.createDataFrame([(1, "w2 x")], "key int, text string"))

    def found():
        corpus = files.scan_text_corpus(spark, str(tmp_path / "r"))
        cards = recommend_records(corpus, own, names.where("name = 'Ann B1'"), names, hashing_vectors)
        return "binaryFile" in plan_of(corpus), sorted(tuple(r) for r in cards.collect())

    listed_by_spark, expected = found()
    monkeypatch.setattr(files, "LISTED", 10, raising=False)
    assert listed_by_spark and found() == (False, expected) and len(expected) == 19
