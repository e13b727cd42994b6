from __future__ import annotations

import datetime as dt

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from marginalia.operators import select

T = dt.datetime(2024, 1, 10, 12)


def _papers(spark, times):
    rows = [(i, t, ["x", "y"] if i % 2 else ["z"]) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "key int, published timestamp, categories array<string>")


def test_window_is_inclusive(spark):
    day = dt.timedelta(days=1)
    papers = _papers(spark, [T, T - day, T - day - dt.timedelta(microseconds=1)])
    assert sorted(r.key for r in select.recent_window(papers, days=1).collect()) == [0, 1]
    assert [r.key for r in select.recent_window(papers, days=0).collect()] == [0]
    assert {r.key for r in select.recent_window(papers, days=2, cap=None).collect()} == {0, 1, 2}
    assert sorted(r.key for r in select.recent_window(papers, days=2, cap=2).collect()) == [0, 1]


def test_window_ends_at_the_newest_match(spark):
    papers = _papers(spark, [T, T - dt.timedelta(days=3)])
    assert [r.key for r in select.recent_window(papers, ["y"], days=1).collect()] == [1]
    assert select.recent_window(papers, ["none"], days=1).count() == 0


def test_latest_of_nothing_is_now(spark):
    latest = select.latest_timestamp(_papers(spark, [T]).where("key < 0")).first().latest
    assert abs((dt.datetime.now() - latest).total_seconds()) < 86_400


def test_window_bound_is_pushed_to_the_scan(spark, tmp_path):
    _papers(spark, [T]).write.parquet(str(tmp_path / "papers"))
    recent = select.recent_window(spark.read.parquet(str(tmp_path / "papers")), days=1).select("key", "published")
    plan = plan_of(recent)
    assert "GreaterThanOrEqual(published" in plan
    assert "Join" not in plan and "categories" not in plan


def test_a_cap_leaves_the_texts_where_they_are(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS key", "timestamp_seconds(id) AS published", "repeat('x', 50) AS abstract")
    rows.write.parquet(str(tmp_path / "papers"))
    stored = spark.read.parquet(str(tmp_path / "papers"))
    assert select.recent_window(stored, days=9).count() == 4000
    recent = select.recent_window(stored, days=9, cap=1500)
    assert {r.key for r in recent.collect()} == set(range(2500, 4000))
    assert recent.rdd.getNumPartitions() > 1 and "BroadcastHashJoin" in plan_of(recent)


def test_categories(spark):
    papers = _papers(spark, [T, T])
    assert [r.key for r in select.category_filter(papers, ["y", "q"]).collect()] == [1]
    assert select.category_filter(papers, []).count() == 2
    single = papers.withColumn("categories", F.element_at("categories", 1))
    assert [r.key for r in select.category_filter(single, ["x"]).collect()] == [1]


def _scores(spark):
    rows = [("a", 0.9), ("b", 0.8), ("c", 0.5), ("d", -0.1), ("e", float("nan")), ("f", 0.8), ("g", None)]
    return spark.createDataFrame(rows, "key string, score double").withColumn("section", F.lit("s"))


def test_threshold_drops_nan(spark):
    assert {r.key for r in select.score_threshold(_scores(spark), 0.5).collect()} == {"a", "b", "c", "f"}
    assert "e" not in {r.key for r in select.score_threshold(_scores(spark)).collect()}


def test_top_n_breaks_ties_by_key(spark):
    best = select.top_n(select.score_threshold(_scores(spark)), 3)
    assert [r.key for r in best.collect()] == ["a", "b", "f"]
    assert "TakeOrderedAndProject" in plan_of(best)


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_per_section(spark, n):
    scores = spark.range(6000).select(
        F.col("id").alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("score"),
        F.when(F.col("id") % 3 == 0, "few").otherwise("many").alias("section"),
    )
    rows = scores.collect()
    best = select.top_n_per_section(scores, n)
    assert "WindowGroupLimit" in plan_of(best) or n > 1000
    got = {(r.section, r["rank"]): r.key for r in best.collect()}
    wanted = {}
    for section in ("few", "many"):
        ordered = sorted((r for r in rows if r.section == section), key=lambda r: (-r.score, r.key))
        wanted |= {(section, i + 1): r.key for i, r in enumerate(ordered[:n])}
    assert got == wanted


def test_retain_last_n(spark):
    reports = spark.createDataFrame([(f"2024-01-{d:02d}", k) for d in range(1, 11) for k in "ab"], "run_date string, md string")
    kept = select.retain_last_n(reports, 3)
    assert {r.run_date for r in kept.collect()} == {"2024-01-08", "2024-01-09", "2024-01-10"}
    assert kept.count() == 6 and "Window" not in plan_of(kept)
