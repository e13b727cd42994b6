"""Versions, the pointer that switches them, and the vector store built on them."""

from __future__ import annotations

import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators.state import with_hash
from marginalia.operators.text import compose_text
from marginalia.operators.vectors import hashing_vectors
from marginalia.options import ModelOptions, RecommendOptions
from marginalia.plans import daily
from marginalia.sources import tables
from marginalia.sources.vector_store import VectorStore, refresh
from marginalia.sources.versions import newest, publish, versions

MODEL = "m"


def corpus(spark, items):
    return spark.createDataFrame([(k, f"Title: {t}\nAbstract:\n{t}\nDate: d\n") for k, t in items], "key string, content string")


def rows(frame):
    return sorted((r.key, r.content_hash, r.fingerprint, tuple(round(x, 6) for x in r.vec)) for r in frame.collect())


def rebuilt(docs, model=MODEL):
    return rows(hashing_vectors(compose_text(with_hash(docs))).withColumn("fingerprint", F.lit(model)))


def counting(seen):
    def encode(texts):
        seen.append(sorted(r.key for r in texts.select("key").collect()))
        return hashing_vectors(texts)

    return encode


def test_one_changed_row_is_one_small_file(spark, tmp_path):
    store, seen = VectorStore(str(tmp_path / "v")), []
    items = {f"k{i}": f"text of {i}" for i in range(50)}
    first = refresh(store, corpus(spark, items.items()).repartition(8), counting(seen), MODEL)
    base = store.parts(spark)[0]
    items["k7"] = "another text"
    second = refresh(store, corpus(spark, items.items()).repartition(8), counting(seen), MODEL)
    assert seen[1] == ["k7"] and store.parts(spark)[0] == base
    (change,) = store.parts(spark)[1]
    assert change.n_rows == 1 and len(glob.glob(f"{change.folder}/part-*")) == 1
    assert rows(store.read(spark)) == rebuilt(corpus(spark, items.items()))
    # An earlier version reads as before; nothing new is written when nothing changed.
    assert "another text" not in str(rows(store.read(spark, first))) and rows(store.read(spark, first)) != rows(store.read(spark))
    assert refresh(store, corpus(spark, items.items()), counting(seen), MODEL) == second and len(seen) == 2


def test_tombstones_and_returning_keys(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"), compact_share=10.0)
    states = [{"a": "1", "b": "2", "c": "3"}, {"a": "1", "c": "4"}, {"a": "1", "b": "2", "c": "4", "d": "5"}, {"d": "5"}, {}, {"a": "9"}]
    for state in states:
        docs = corpus(spark, state.items()) if state else corpus(spark, [("x", "x")]).where("false")
        refresh(store, docs, hashing_vectors, MODEL)
        assert rows(store.read(spark)) == rebuilt(docs)
    assert len(store.parts(spark)[1]) == len(states) - 1


def test_repeated_keys_other_models_and_null_keys(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"), compact_share=10.0)
    docs = corpus(spark, [("a", "1"), ("a", "2"), ("b", "3"), (None, "4")])
    refresh(store, docs, hashing_vectors, MODEL)
    keyed = docs.where("key IS NOT NULL")
    assert rows(store.read(spark)) == rebuilt(keyed)
    docs = corpus(spark, [("a", "1"), ("a", "5"), ("b", "3")])
    refresh(store, docs, hashing_vectors, MODEL)
    assert rows(store.read(spark)) == rebuilt(docs)
    seen = []
    refresh(store, docs, counting(seen), "n")
    assert seen == [["a", "a", "b"]] and rows(store.read(spark)) == rebuilt(docs, "n")


def test_changes_are_compacted(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"), compact_share=0.2)
    items = {f"k{i}": f"text {i}" for i in range(20)}
    refresh(store, corpus(spark, items.items()), hashing_vectors, MODEL)
    for i in range(6):
        items[f"k{i}"] = f"new {i}"
        refresh(store, corpus(spark, items.items()), hashing_vectors, MODEL)
        base, changes = store.parts(spark)
        assert sum(c.n_rows for c in changes) <= 0.2 * base.n_rows
        assert rows(store.read(spark)) == rebuilt(corpus(spark, items.items()))
    assert [v.kind for v in versions(spark, store.path)].count("base") == 2


def failing(texts):
    bad = F.udf(lambda text: 1 / 0, "array<double>")
    return texts.withColumn("vec", bad("text")).drop("text")


def test_a_failing_encoder_leaves_the_store(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"))
    docs = corpus(spark, [("a", "1"), ("b", "2")])
    refresh(store, docs, hashing_vectors, MODEL)
    with pytest.raises(PySparkException):
        refresh(store, corpus(spark, [("a", "1"), ("b", "3")]), failing, MODEL)
    assert rows(store.read(spark)) == rebuilt(docs)


def test_a_failing_snapshot_leaves_the_old_one(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "key string, section string"
    assert tables.read_snapshot(spark, path, schema).count() == 0
    tables.replace_snapshot(spark.createDataFrame([("a", "x"), ("b", "y")], schema), path)
    bad = F.udf(lambda key: 1 / 0, "string")
    with pytest.raises(PySparkException):
        tables.replace_snapshot(spark.createDataFrame([("c", "x")], schema).withColumn("key", bad("key")), path)
    current = tables.read_snapshot(spark, path, schema)
    assert sorted(map(tuple, current.collect())) == [("a", "x"), ("b", "y")]
    # A snapshot may be made from the one it replaces, and the older versions go.
    for _ in range(3):
        current = tables.read_snapshot(spark, path, schema)
        tables.replace_snapshot(current.where("section = 'x'"), path)
    assert [tuple(r) for r in tables.read_snapshot(spark, path, schema).collect()] == [("a", "x")]
    assert len(glob.glob(f"{path}/whole-*")) == 2


def test_publish_resolves_the_newest_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert newest(spark, path) is None
    for n in (1, 2, 3):
        made = publish(spark, path, lambda folder, number: spark.range(number).write.parquet(folder))
        assert made.number == n == made.n_rows == newest(spark, path).count()


def test_a_failing_day_keeps_vectors_state_and_report(spark, tmp_path):
    folder, schema = str(tmp_path), "key string, title string, authors array<string>, abstract string, url string, published timestamp, categories array<string>"
    day = spark.sql("SELECT timestamp '2024-01-01' AS t").first().t
    papers = spark.createDataFrame([("p", "words", ["A B"], "some words", "u", day, ["c"])], schema)
    none = spark.createDataFrame([], "name string")
    options = RecommendOptions(categories=("c",))

    def run(own, encode):
        daily.daily_job(papers, own, folder, none, none, encode, "2024-01-02", options, ModelOptions("hashing"))

    docs = corpus(spark, [("a", "words"), ("b", "more")])
    run(docs, hashing_vectors)
    before = daily.read_state(spark, folder).collect()
    with pytest.raises(PySparkException):
        run(corpus(spark, [("a", "words"), ("b", "other")]), failing)
    assert daily.read_state(spark, folder).collect() == before
    assert rows(daily.vector_store(folder).read(spark, before[0].vectors)) == rebuilt(docs, before[0].fingerprint)
    run(corpus(spark, [("a", "words"), ("b", "other")]), hashing_vectors)
    assert daily.read_state(spark, folder).first().vectors > before[0].vectors
