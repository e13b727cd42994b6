"""Mixing, embedding and text near-duplicates against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import parity
import pytest
from conftest import plan_of
from fixtures import documents, prose
from pyspark.sql import functions as F

from marginalia.llm import dart, mixing, queries, subspace
from marginalia.llm.components import components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    assert "CartesianProduct" not in plan_of(frame) and "NestedLoopJoin" not in plan_of(frame)
    assert parity.difference(frame, parity.connect(sf_dir), queries.ORACLES[name]) is None


def test_mixing_targets_and_rows(spark):
    docs = documents(spark, extra=True)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count()
    by_source: dict = {}
    for r in mixed:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and rows[0].target <= 2 * rows[0].source_size
    assert abs(sum(rows[0].target for rows in by_source.values()) - 1.5 * sum(r.size for r in mixed)) < 1e-6
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect():
        got[r.doc_id] += r.n
    want = Counter()
    for r in mixed:
        want[r.doc_id] += r.taken
    assert got == want
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mix_rows(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None, "s"), (2, "", None, "t")])).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("key", [1, None])
def test_rows_of_one_id_meet_the_target(spark, key):
    """Rows that share an id, or have none, are taken one by one, and what the table names its columns does not matter."""
    text = " ".join("w" * 50)
    docs = documents(spark, [(key, text, "a", "s")] * 40 + [(2, text + " x", "a", "t")] * 3, extra=True).withColumn("_x__x_row", F.lit(7))
    mixed = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    made = mixing.mix_rows(docs)
    rows = made.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words"), F.max("_x__x_row").alias("x")).collect()
    assert {r.source: r.words for r in rows} == {s: r.taken for s, r in mixed.items()} and {r.x for r in rows} == {7}
    assert all(abs(r.taken - r.target) <= 1 for r in mixed.values()) and made.columns == docs.columns


def test_water_filling_reshares_until_none_is_above(spark):
    rows = [("a", 10), ("b", 1000), ("c", 50), ("d", 400)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # 2190 words; a and c stop at 20 and 100; 2070 for b : d = 2 : 5, but d stops at 800 and b gets the rest
    assert got == {"a": 20.0, "c": 100.0, "d": 800.0, "b": 1270.0}


def _brute_vectors(vectors: dict) -> dict:
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in vectors}
    for i, x in good.items():
        for j, y in good.items():
            if i != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links[i].add(j)
    out = {}
    for i in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("options", [subspace.SubspaceOptions(), subspace.SubspaceOptions(cell_rows=4, tile_rows=7), subspace.SubspaceOptions(block_width=3)])
def test_vectors_equal_brute_force(spark, options):
    rng = np.random.default_rng(3)
    vectors: dict = {}
    for c in range(12):
        center = rng.standard_normal(16)
        for n in range(9):
            near = center + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2, 0.3])
            vectors[100 * c + n] = [float(x) for x in near * rng.choice([1e-3, 1.0, 50.0])]
    hot = rng.standard_normal(16).tolist()
    vectors |= {2000 + n: hot for n in range(40)}
    vectors |= {3000: None, 3001: [], 3002: [0.0] * 16, 3003: [float("nan")] + [1.0] * 15, 3004: [None] + [1.0] * 15,
                3005: [float("inf")] * 16, 3006: [1.0, 2.0], 3007: [2.0, 4.0], 3008: [-x for x in hot]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").withColumn("copies", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_duplicates(frame, options).collect()}
    assert got == _brute_vectors(vectors)


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert subspace.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in subspace.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_embedding_query_equals_brute_force(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op6_subspace_pigeonhole(spark, sf_dir).collect()}
    assert got == _brute_vectors(rows)


def _classes(texts: dict) -> dict:
    """Components of the exact weighted Jaccard graph, by brute force over all pairs."""
    bags = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        bags[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    ids = sorted(texts)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sizes = {i: sum(b.values()) for i, b in bags.items()}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sizes[i] and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]):
                both = sum((bags[i] & bags[j]).values())
                if both and both / (sizes[i] + sizes[j] - both) >= 0.8:
                    a, b = sorted((find(i), find(j)))
                    label[b] = a
    return {i: find(i) for i in ids}


def test_dart_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in queries.op7_dart_minhash(spark, sf_dir).collect()} == _classes(texts)


@pytest.mark.parametrize("small,tile_rows", [(16, 64), (0, 5), (1000, 64)])
def test_a_group_of_near_copies_is_whole_on_every_path(spark, small, tile_rows):
    import random

    rng = random.Random(5)
    base = prose(9, 120).split()
    texts: dict = {}
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        texts[i] = " ".join(words)
    texts |= {100 + i: prose(9, 60) + " " + prose(50 + i, 60) for i in range(20)}
    texts |= {200: None, 201: "", 202: "one two", 203: "one  two", 204: prose(2, 9000), 205: prose(2, 9000)}
    docs = documents(spark, [(i, t, "a", "s") for i, t in texts.items()], extra=True)
    got = {r.doc_id: r.class_id for r in dart.near_duplicates(docs, dart.DartOptions(small=small, tile_rows=tile_rows)).collect()}
    assert got == _classes(texts)
    kept = dart.first_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_dart_edges(spark):
    rows = dart.near_duplicates(documents(spark)).collect()
    assert len(rows) == 12
    got = {r.doc_id: r.class_id for r in rows}
    assert got[2] == 1 and got[9] == 8 and got[4] == 4 and got[5] == 5 and got[6] == 6 and got[None] is None and got[10] == 10
    assert dart.near_duplicates(documents(spark, [])).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (300, 100, 50))
    cells = np.concatenate([np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b])), shared[:1]])
    signature = dart.signatures(cells, np.array([0, 400, 750, 751]), 4000)
    assert abs((signature[0] == signature[1]).mean() - 300 / 450) < 0.04
    weights = np.concatenate([np.full(400, 0.5), np.full(350, 0.5), [0.25]])
    halves = dart.signatures(cells, np.array([0, 400, 750, 751]), 4000, weights)
    assert abs((halves[0] == halves[1]).mean() - 300 / 450) < 0.04 and (halves[2] != 0).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_texts_of_one_id_and_rows_without_one(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = a.replace(a.split()[40], "zz", 1)
    rows = [(3, a, "x", "s"), (5, a, "x", "s"), (5, b, "x", "s"), (None, a, "x", "s"), (None, a, "x", "s"), (None, c, "x", "s"),
            (None, c, "x", "s"), (7, near, "x", "s"), (7, b + " ", "x", "t"), (8, "", "x", "s"), (8, "", "x", "s"), (None, None, "x", "s")]
    docs = documents(spark, rows, extra=True)
    classes = Counter((r.doc_id, r.class_id) for r in dart.near_duplicates(docs).collect())
    assert classes == Counter({(3, 3): 1, (5, 3): 1, (5, 5): 1, (None, 3): 2, (None, None): 3, (7, 3): 1, (7, 5): 1, (8, 8): 2})
    kept = dart.first_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (5, b), (None, c), (8, ""), (8, ""), (None, None)])


def test_an_arena_with_outliers(spark):
    """A large component, smaller ones and single texts that share words: links are those of all pairs."""
    rng = np.random.default_rng(5)
    words = prose(11, 60).split()
    texts = []
    for i in range(90):
        changed = list(words)
        for at in rng.choice(60, 1 if i < 60 else int(rng.integers(2, 20)), replace=False):
            changed[at] = f"q{i}x{at}"
        texts.append(" ".join(changed))
    docs = documents(spark, [(i, t, "x", "s") for i, t in enumerate(texts)])
    plain = {r.doc_id: r.class_id for r in dart.near_duplicates(docs, dart.DartOptions(small=10_000)).collect()}
    for tile_rows in (3, 64):
        tiled = dart.near_duplicates(docs, dart.DartOptions(small=1, tile_rows=tile_rows)).collect()
        assert {r.doc_id: r.class_id for r in tiled} == plain
