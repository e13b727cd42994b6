"""Differences found bucket by bucket, and polls whose known keys are state of the stream."""

from __future__ import annotations

from collections import Counter

import pytest

from marginalia.operators import state
from marginalia.streaming.daily import poll_with_state


@pytest.mark.parametrize("bucket_rows", [1, 16, 10_000])
def test_localised_changes_equal_the_full_join(spark, bucket_rows):
    schema = "key string, content string"
    old = [(f"k{i}", f"t{i}") for i in range(400)] + [(None, "x"), ("gone", None)]
    new = [(f"k{i}", f"t{i}" if i % 97 else "other") for i in range(3, 405)] + [(None, "x"), (None, "y"), ("twice", "1"), ("twice", "2"), ("gone", None)]
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows in (old, new)]
    want = Counter(map(tuple, state.changed_rows(*frames).collect()))
    found = state.changed_rows_localised(*frames, bucket_rows=bucket_rows)
    assert Counter(map(tuple, found.collect())) == want and len(set(want.values())) > 1
    none = frames[0].where("false")
    for pair in ((none, frames[1]), (frames[0], none), (none, none)):
        assert Counter(map(tuple, state.changed_rows_localised(*pair).collect())) == Counter(map(tuple, state.changed_rows(*pair).collect()))


def test_one_changed_row_joins_one_bucket(spark, monkeypatch):
    rows = [(f"k{i}", f"t{i}") for i in range(2000)]
    frames = [spark.createDataFrame(r, "key string, content string") for r in (rows, [("k7", "new"), *(r for r in rows if r[0] != "k7")])]
    kept = {}

    def staged(frame, name):
        kept[name] = real(frame, name)
        return kept[name]

    real = state.staged
    monkeypatch.setattr(state, "staged", staged)
    assert Counter(r.change for r in state.changed_rows_localised(*frames).collect()) == {"unchanged": 1999, "changed": 1}
    joined = kept["new-hashes"].join(kept["equal-buckets"], "bucket", "left_anti").count()
    assert 1 <= joined < 60


def test_state_of_a_poll_replays_late_rows_and_expiry(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / p) for p in ("inbox", "table", "checkpoint"))
    schema = "key string, value string, at timestamp"

    def poll(rows):
        made = spark.createDataFrame(rows, "key string, value string, at string").selectExpr("key", "value", "timestamp(at) AS at")
        made.coalesce(1).write.mode("append").parquet(inbox)
        return again()

    def again():
        poll_with_state(spark, inbox, schema, table, checkpoint, "at", "2 days").awaitTermination(60)
        return sorted((r.key, r.value) for r in spark.read.parquet(table).collect())

    assert poll([("a", "1", "2024-01-01"), ("b", "1", "2024-01-01"), (None, "1", "2024-01-01")]) == [("a", "1"), ("b", "1")]
    assert poll([("a", "2", "2024-01-02"), ("c", "2", "2024-01-02")]) == [("a", "1"), ("b", "1"), ("c", "2")]
    assert again() == [("a", "1"), ("b", "1"), ("c", "2")]  # nothing new
    # Ten days on, what is older than the watermark is too late, and its key is no longer known.
    assert poll([("d", "3", "2024-01-12")]) == [("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")]
    assert poll([("late", "4", "2024-01-05"), ("a", "4", "2024-01-12")]) == [("a", "1"), ("a", "4"), ("b", "1"), ("c", "2"), ("d", "3")]
