from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from marginalia.catalog.queries import hashing_encoder_factory
from marginalia.functions import vectors as V
from marginalia.operators import similarity, vectors


def _vectors(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "key int, vec array<float>")


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(7)
    new = rng.normal(size=(60, 12)).astype("float32")
    mine = rng.normal(size=(17, 12)).astype("float32")
    new[3] = 0
    frames = [
        _vectors(spark, [[float(x) for x in v] for v in new]).withColumn("section", F.lit("s")),
        _vectors(spark, [[float(x) for x in v] for v in mine]),
    ]
    lengths = np.linalg.norm(new.astype(float), axis=1, keepdims=True)
    unit = np.divide(new, lengths, out=np.zeros_like(new, dtype=float), where=lengths > 0)
    own = mine.astype(float) / np.linalg.norm(mine.astype(float), axis=1, keepdims=True)
    return *frames, unit @ own.T


@pytest.mark.parametrize("own_bytes", [similarity.OWN_BYTES, 12 * 8 * 4])
def test_scores_equal_dense_matrix(sets, own_bytes):
    """The broadcast and the tiled way give the row maxima; other columns pass through."""
    new, mine, matrix = sets
    scored = similarity.score_candidates(new, mine, own_bytes)
    assert scored.columns == ["key", "section", "score"]
    got = {r.key: r.score for r in scored.collect()}
    assert got == pytest.approx({i: row.max() for i, row in enumerate(matrix)}, abs=1e-12)
    assert got[3] == 0.0


@pytest.mark.parametrize("own_bytes", [similarity.OWN_BYTES, 12 * 8 * 4])
@pytest.mark.parametrize("floor", [-1.01, 0.0, 0.4])
def test_pairs_equal_dense_matrix(sets, own_bytes, floor):
    new, mine, matrix = sets
    got = {(r.key, r.my_key): r.sim for r in similarity.cosine_pairs(new, mine, floor, own_bytes).collect()}
    wanted = {(i, j): s for (i, j), s in np.ndenumerate(matrix) if s >= floor}
    assert got == pytest.approx(wanted, abs=1e-12)


def test_max_of_pairs_equals_fused(sets):
    new, mine, _ = sets
    pairs = similarity.cosine_pairs(new, mine, -1.01)
    slow = {r.key: r.score for r in similarity.max_similarity(pairs).collect()}
    assert slow == pytest.approx({r.key: r.score for r in similarity.score_candidates(new, mine).collect()})


def test_small_blocks(spark, sets, monkeypatch):
    new, mine, matrix = sets
    whole = similarity._kernel
    monkeypatch.setattr(similarity, "_kernel", lambda: whole(block_bytes=64))
    got = {r.key: r.score for r in similarity.score_candidates(new, mine).collect()}
    assert got == pytest.approx({i: row.max() for i, row in enumerate(matrix)}, abs=1e-12)


def test_cosine_expression(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.c for r in rows.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, 0.0]


@pytest.mark.parametrize(
    ("new", "mine", "message"),
    [
        ([[1.0, float("nan")]], [[1.0, 0.0]], "NaN"),
        ([[1.0, float("inf")]], [[1.0, 0.0]], "infinity"),
        ([[1.0, 0.0, 0.0]], [[1.0, 0.0]], "widths differ"),
        ([[1.0, 0.0], [1.0]], [[1.0, 0.0]], "widths differ"),
        ([[1.0, None]], [[1.0, 0.0]], "NULL"),
        ([[1.0, 0.0]], [], "empty"),
        ([[1.0, 0.0]], [[1.0, float("nan")]], "NaN"),
    ],
)
def test_bad_vectors_are_errors(spark, new, mine, message):
    with pytest.raises(Exception, match=message):
        similarity.score_candidates(_vectors(spark, new).coalesce(1), _vectors(spark, mine)).collect()


def test_scoring_does_not_shuffle(sets):
    new, mine, _ = sets
    plan = plan_of(similarity.score_candidates(new, mine))
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_dims(spark):
    a, b = _vectors(spark, [[1.0, 2.0]]), _vectors(spark, [[1.0, 2.0, 3.0]])
    assert vectors.check_dims(a, b).first() == (2, 2, 3, 3, False)
    vectors.require_dims(a, a)
    with pytest.raises(ValueError, match="widths differ"):
        vectors.require_dims(a, b)


def test_pooling(spark):
    rows = [
        ("a", 0, [2.0, 4.0], 1), ("a", 1, [4.0, 8.0], 1), ("a", 2, [9.0, 9.0], 0), ("b", 0, [1.0, 2.0], 0),
    ]
    tokens = spark.createDataFrame(rows, "key string, pos int, vec array<float>, mask int").repartition(3)
    means = {r.key: r.vec for r in vectors.mean_pool(tokens).collect()}
    assert means == {"a": pytest.approx([3.0, 6.0]), "b": [0.0, 0.0]}
    firsts = {r.key: r.vec for r in vectors.first_token_pool(tokens).collect()}
    assert firsts == {"a": [2.0, 4.0], "b": [1.0, 2.0]}


def test_mean_pool_combines_before_the_shuffle(spark):
    tokens = spark.createDataFrame([("a", 0, [1.0], 1)], "key string, pos int, vec array<float>, mask int")
    plan = plan_of(vectors.mean_pool(tokens))
    assert plan.count("ObjectHashAggregate") == 2 and "partial" in plan and "Generate" not in plan


def test_l2_normalize(spark):
    got = [r.vec for r in vectors.l2_normalize(_vectors(spark, [[3.0, 4.0], [0.0, 0.0]])).collect()]
    assert got == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_encoders_agree_and_keep_columns(spark):
    rows = [(i, f"Word{i} le Été le　x", "s") for i in range(40)] + [(99, "", "s")]
    texts = spark.createDataFrame(rows, "key int, text string, section string")
    built_in = {r.key: (r.section, r.vec) for r in vectors.hashing_vectors(texts).collect()}
    python = {r.key: (r.section, r.vec) for r in vectors.embed(texts, hashing_encoder_factory()).collect()}
    assert built_in.keys() == python.keys()
    for key, (section, vec) in built_in.items():
        assert section == python[key][0] and vec == pytest.approx(python[key][1])
    assert math.isclose(sum(x * x for x in built_in[0][1]), 1.0)
    assert set(built_in[99][1]) == {0.0}


def test_encoder_gets_whole_texts_in_batches(spark):
    def factory():
        def encoder(batch):
            assert len(batch) <= 16
            return [[len(t), len(batch)] for t in batch]

        return encoder

    texts = spark.createDataFrame([(i, "x" * 5000) for i in range(40)], "key int, text string").coalesce(1)
    vecs = [r.vec for r in vectors.embed(texts, factory).collect()]
    assert len(vecs) == 40
    assert {round(v[0] / v[1]) for v in vecs} == {round(5000 / 16), round(5000 / 8)}


@pytest.mark.parametrize("own_bytes", [similarity.OWN_BYTES, 16])
def test_equal_rows_stay_rows_on_every_path(spark, own_bytes):
    new = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [1.0, 1.0], "y")], "key int, vec array<double>, tag string")
    mine = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "key int, vec array<double>")
    scored = similarity.score_candidates(new, mine, own_bytes)
    assert scored.columns == ["key", "tag", "score"]
    assert sorted((r.key, round(r.score, 4)) for r in scored.collect()) == [(1, 0.9487), (1, 1.0), (1, 1.0), (2, 1.0)]
    pairs = similarity.cosine_pairs(new, mine, 0.99, own_bytes).collect()
    assert sorted((r.key, r.my_key) for r in pairs) == [(1, 0), (1, 0), (2, 1)]


def test_a_named_encoder_is_loaded_once_per_worker(spark, tmp_path):
    def factory():
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        return lambda batch: [[float(len(t)), 1.0] for t in batch]

    texts = spark.range(0, 400, 1, 40).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    assert vectors.embed(texts, factory, encoder_id="lengths").count() == 400
    assert 0 < len(vectors.embed(texts, factory, encoder_id="lengths").collect()) and len(list(tmp_path.iterdir())) <= 8


@pytest.mark.parametrize("leaders", [1, 3, 50])
def test_groups_skip_what_cannot_win(spark, leaders):
    """Clusters, copies, one popular group, and vectors of length zero on both sides; own keys may repeat."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    near = lambda n, spread: [[float(x) for x in middles[i % 6] + spread * rng.normal(size=8)] for i in range(n)]
    new, mine = near(200, 0.01) + [[0.0] * 8] + near(1, 0.01) * 300, near(60, 0.01) + [[0.0] * 8] * 3 + near(1, 0.0) * 40
    frames = _vectors(spark, new), _vectors(spark, mine).withColumn("key", F.col("key") % 50)
    whole = {r.key: r.score for r in similarity.score_candidates(*frames).collect()}
    got = {r.key: r.score for r in similarity.score_candidates(*frames, 64 * 10, leaders).collect()}
    assert got == pytest.approx(whole, abs=1e-12) and got[200] == 0.0
    for floor in (-0.5, 0.0, 0.999):
        pairs = sorted((r.key, r.my_key) for r in similarity.cosine_pairs(*frames, floor).collect())
        assert sorted((r.key, r.my_key) for r in similarity.cosine_pairs(*frames, floor, 64 * 10, leaders).collect()) == pairs
    if leaders == 50:
        groups = similarity.group_own(frames[1], leaders)
        worth = [len(r._groups) for r in similarity.choose_groups(frames[0], groups, 0.99).collect()]
        assert np.mean(worth) < 0.4 * len(groups.ids)


def test_own_vectors_of_length_zero_only(spark):
    new, mine = _vectors(spark, [[1.0, 0.0], [0.0, 0.0]]), _vectors(spark, [[0.0, 0.0]] * 5)
    assert [r.score for r in similarity.score_candidates(new, mine, 16).collect()] == [0.0, 0.0]
    assert similarity.cosine_pairs(new, mine, 0.0, 16).count() == 10 and similarity.cosine_pairs(new, mine, 0.1, 16).count() == 0


def test_small_groups_share_tiles(spark, monkeypatch):
    """A vector is sent once to a tile of many groups, and what is found does not depend on the tiles."""
    rng = np.random.default_rng(5)
    draw = lambda n: [[float(x) for x in rng.normal(size=8)] for _ in range(n)]
    frames = _vectors(spark, draw(60)), _vectors(spark, draw(400))
    groups = similarity.group_own(frames[1], 20)
    sets = similarity.shared_tiles(groups, 1000)
    assert len(groups.ids) > 50 and set(sets) == {groups.ids.min()}
    assert [len(r._groups) for r in similarity.choose_groups(frames[0], groups, 0.0, sets).collect()] == [1] * 60
    split = similarity.shared_tiles(groups, 50)
    held = [groups.rows[split == s].sum() for s in set(split)]
    assert len(held) > 5 and all(n <= max(50, groups.rows.max()) for n in held)
    scores = {r.key: r.score for r in similarity.score_candidates(*frames).collect()}
    pairs = sorted((r.key, r.my_key) for r in similarity.cosine_pairs(*frames, 0.3).collect())
    for tile_bytes in (1, 64 * 50, similarity.TILE_BYTES):
        monkeypatch.setattr(similarity, "TILE_BYTES", tile_bytes)
        assert {r.key: r.score for r in similarity.score_candidates(*frames, 64 * 20, 20).collect()} == pytest.approx(scores, abs=1e-12)
        assert sorted((r.key, r.my_key) for r in similarity.cosine_pairs(*frames, 0.3, 64 * 20, 20).collect()) == pairs


def test_mean_pool_aggregates_few_rows(spark):
    """Tokens that lie together are added up before the aggregate, whose sort they would fill; odd keys and masks count too."""
    ids = spark.range(0, 30_000, 1, 3).select("id", (F.col("id") / 100).cast("int").alias("key"))
    tokens = ids.select("key", F.col("id").alias("pos"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"), (F.col("id") % 2).cast("int").alias("mask"))
    rows = tokens.select("key", F.transform("vec", lambda x: x * F.col("mask")).alias("total"), F.col("mask").cast("bigint").alias("weight"))
    combined = vectors._combined(rows)
    assert 300 <= combined.count() < 330 and combined.agg(F.sum("weight")).first()[0] == 15_000
    means = {r.key: r.vec for r in vectors.mean_pool(tokens).collect()}
    assert means == {k: pytest.approx([100 * k + 50.0, 1.0]) for k in range(300)}
    odd = [(None, 0, [2.0], 0.5), (None, 1, [4.0], 0.5), ("", 0, [1.0], 0.0), ("a", 0, [float("nan")], 1.0), ("b", 0, [3.0], 2.0)]
    found = {r.key: r.vec for r in vectors.mean_pool(spark.createDataFrame(odd, "key string, pos int, vec array<float>, mask double").coalesce(1)).collect()}
    assert math.isnan(found.pop("a")[0]) and found == {None: [3.0], "": [0.0], "b": [3.0]}
    keyed = tokens.select(F.struct("key").alias("key"), "pos", "vec", "mask")
    assert vectors.mean_pool(keyed).count() == 300
