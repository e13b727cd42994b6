from __future__ import annotations

import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from marginalia.operators import state
from marginalia.operators.vectors import hashing_vectors
from marginalia.operators.text import compose_text
from marginalia.options import ModelOptions
from marginalia.session import scratch_path, staged
from marginalia.sources import files, tables
from marginalia.sources.papers import author_papers
from marginalia.streaming.daily import poll_new_records


def test_scan_text_corpus(spark, tmp_path):
    (tmp_path / "a b+c%é.txt").write_bytes("x\r\ny\rz\n".encode())
    (tmp_path / "skip.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("no")
    rows = files.scan_text_corpus(spark, str(tmp_path)).collect()
    assert [(r.key, r.content) for r in rows] == [("a b+c%é.txt", "x\ny\nz\n")]


def test_scan_name_list(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("  Ann One \n\n\t\n B Two")
    assert sorted(r.name for r in files.scan_name_list(spark, str(path)).collect()) == ["Ann One", "B Two"]
    missing = files.scan_name_list(spark, str(tmp_path / "none.txt"))
    assert missing.columns == ["name"] and missing.count() == 0


def test_reports_on_disk(spark, tmp_path):
    path = str(tmp_path / "reports")

    def write(rows):
        files.report_sink(spark.createDataFrame(rows, "run_date string, md string"), path)

    write([("2024-01-01", "one\n\n"), ("odd", "two\n")])
    write([("2024-01-01", "new\n")])
    back = {r.run_date: r.md for r in files.scan_reports(spark, path).collect()}
    assert back == {"2024-01-01": "new\n", "odd": "two\n"}


def test_export_sink(spark, tmp_path):
    files.export_sink(spark.createDataFrame([("r", "u1\nu2")], "run string, links string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value == "u1\nu2\n"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, n int")


def test_insert_new(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.append_new(spark, path, _rows(spark, [("k2", "old", 0)]), "key", F.col("n"))
    batch = _rows(spark, [("k1", "first", 1), ("k2", "ignored", 2), ("k1", "second", 3)])
    for _ in range(2):  # a replay adds nothing
        tables.append_new(spark, path, batch, "key", F.col("n"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("k1", "first", 1), ("k2", "old", 0)]


def test_overwrite_by_key(spark):
    rows = [("hot", f"v{i}", i) for i in range(500)] + [("cold", "c", 0)]
    last = tables.overwrite_by_key(_rows(spark, rows).repartition(4), "key", F.col("n"))
    assert sorted(map(tuple, last.collect())) == [("cold", "c", 0), ("hot", "v499", 499)]
    assert last.columns == ["key", "value", "n"]


def test_replace_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = spark.createDataFrame([("a", "Priority"), ("b", "Other")], "key string, section string")
    tables.replace_snapshot(rows, path)
    tables.replace_snapshot(rows.where("key = 'b'"), path)
    assert [r.key for r in tables.read_snapshot(spark, path, "key string, section string").collect()] == ["b"]


def test_vectors_and_pairs_on_disk(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, 0.5])], "key string, vec array<double>")
    tables.write_vectors(vectors, str(tmp_path / "v"))
    back = tables.read_vectors(spark, str(tmp_path / "v"))
    assert back.first() == ("a", [1.0, 0.5]) and back.schema["vec"].dataType.simpleString() == "array<float>"
    pairs = spark.createDataFrame([("a", "m", 0.5)], "key string, my_key string, sim double")
    tables.write_pairs(pairs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first() == ("a", "m", 0.5)


def test_author_papers(spark):
    papers = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "key int, author_id string")
    assert {r.key for r in author_papers(papers, "x").collect()} == {1, 3}
    assert author_papers(papers, spark.createDataFrame([("y",), ("y",)], "id string")).first().key == 2


def test_scratch_is_where_the_session_says(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = scratch_path(spark, "x")
    root = root or spark.sparkContext.getCheckpointDir()
    assert path.startswith(root) and path != scratch_path(spark, "x")
    assert staged(spark.range(3), "x").count() == 3


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "key string, content string")


def test_changed_rows(spark):
    before = _corpus(spark, [("a", "1"), ("b", "1"), ("c", "1")])
    now = _corpus(spark, [("b", "1"), ("c", "2"), ("d", "1")])
    got = {r.key: r.change for r in state.changed_rows(before, now).collect()}
    assert got == {"a": "removed", "b": "unchanged", "c": "changed", "d": "new"}


def test_fingerprint(spark):
    def hashes(rows):
        found = state.corpus_fingerprint(spark.createDataFrame(rows, "corpus_id string, content string"))
        return {r.corpus_id: r.content_hash for r in found.collect()}

    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")]
    assert hashes(rows) == hashes(rows[::-1])
    assert hashes(rows)["a"] != hashes(rows[:2])["a"] and hashes(rows)["b"] == hashes(rows[:1])["a"]


def test_model_fingerprint(spark):
    options = ModelOptions("m", True, "b", "a")
    assert state.model_fingerprint(options) == "m|adapters=True|base=b|adapter=a"
    vectors = spark.createDataFrame([("k", "m|adapters=False|base=|adapter="), ("n", None)], "key string, fingerprint string")
    assert [r.key for r in state.stale_vectors(vectors, options).collect()] == ["k"]


@pytest.mark.parametrize(
    ("old", "stored", "check", "wanted"),
    [
        (("h", "f"), True, True, False),
        (("h", "f"), True, False, False),
        (None, True, True, True),
        (None, False, False, False),
        (("g", "f"), True, True, True),
        (("h", "f"), False, True, True),
        (("h", "other"), True, True, True),
        (("h", None), True, True, False),
    ],
)
def test_rebuild_decision(spark, old, stored, check, wanted):
    current = spark.createDataFrame([("c", "h")], "corpus_id string, content_hash string")
    last = spark.createDataFrame(
        [("c", *old)] if old else [], "corpus_id string, content_hash string, fingerprint string"
    )
    present = spark.createDataFrame([("c",)] if stored else [], "corpus_id string")
    assert state.rebuild_decision(current, last, present, "f", check).first().rebuild is wanted


@pytest.mark.parametrize("stage", [True, False])
def test_incremental_equals_full(spark, stage):
    def record(i, body):
        return (f"k{i}", f"Title: t{i}\nAbstract:\n{body}\nDate: d\n")

    old = _corpus(spark, [record(i, "same") for i in range(6)])
    now = _corpus(spark, [record(0, "same"), record(1, "changed"), record(2, "same"), record(9, "new")])

    def full(corpus, fingerprint):
        return hashing_vectors(compose_text(state.with_hash(corpus))).withColumn("fingerprint", fingerprint)

    encoded = []

    def encode(texts):
        encoded.extend(r.key for r in texts.collect())
        return hashing_vectors(texts)

    stored = full(old, F.when(F.col("key") == "k2", "older").when(F.col("key") != "k0", "f"))
    got = state.incremental_vectors(now, stored, encode, "f", stage)
    columns = ["key", "vec", "content_hash", "fingerprint"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full(now, F.lit("f")).select(*columns).collect()))
    assert sorted(encoded) == ["k1", "k2", "k9"]


def test_daily_poll(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / p) for p in ("inbox", "table", "checkpoint"))
    schema = "key string, value string"

    def poll():
        poll_new_records(spark, inbox, schema, table, checkpoint, order="value").awaitTermination(60)
        return sorted(map(tuple, spark.read.parquet(table).collect()))

    spark.createDataFrame([("a", "1"), ("b", "1")], schema).write.parquet(inbox)
    assert poll() == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("a", "2"), ("c", "2")], schema).write.mode("append").parquet(inbox)
    assert poll() == [("a", "1"), ("b", "1"), ("c", "2")]
    assert poll() == [("a", "1"), ("b", "1"), ("c", "2")]


def test_an_empty_rerun_replaces_the_report_of_its_day(spark, tmp_path):
    from marginalia.plans.recommend import daily_report
    from marginalia.sources.files import report_sink, scan_reports

    schema = "section string, rank int, key int, score double, title string, authors string, abstract string, url string, date string"
    one = spark.createDataFrame([("Other", 1, 1, 0.5, "t", "A B", "x", "u", "d")], schema)
    path = str(tmp_path / "reports")
    report_sink(daily_report(one, F.lit("2024-02-01")), path)
    report_sink(daily_report(one, F.lit("2024-02-02")), path)
    report_sink(daily_report(one.where("false"), F.lit("2024-02-02")), path)
    got = {r.run_date: r.md.strip() for r in scan_reports(spark, path).collect()}
    assert got["2024-02-02"] == "" and "### [t](u)" in got["2024-02-01"]


def test_an_empty_folder_and_null_keys(spark, tmp_path):
    path = tmp_path / "table"
    path.mkdir()
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "key int, value string")
    for _ in range(2):
        tables.append_new(spark, str(path), batch, "key", F.col("value"))
    assert [tuple(r) for r in spark.read.parquet(str(path)).collect()] == [(1, "a")]


def test_latest_by_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (1, "b")], "key int, value string")
    got = sorted((r.key or 0, r.value) for r in tables.latest_by_key(rows, "key", F.col("value")).collect())
    assert got == [(0, "d"), (1, "b"), (2, "c")]


def test_latest_by_key_leaves_a_table_without_repeated_keys_alone(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "key string, n int")
    kept = tables.latest_by_key(rows, "key", F.col("n"))
    assert "Join" not in plan_of(kept) and "Union" not in plan_of(kept)
    assert sorted(r.n for r in kept.collect()) == [1, 2, 3, 4]
    again = tables.latest_by_key(rows.union(spark.createDataFrame([("a", 5)], rows.schema)), "key", F.col("n"))
    assert sorted(r.n for r in again.collect()) == [2, 3, 4, 5]
