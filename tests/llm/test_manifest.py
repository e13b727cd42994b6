"""The manifest against a whole-tree computation in memory."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from fixtures import documents, prose

from marginalia.llm import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        yield "".join(run[: i % 3]), "".join(run[i % 3 + 1 :])
        i //= 3


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = [(r, plain_leaf(r, r.text)) for r in by_source[name]]
        own.sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        trees[name] = (own, levels_of([x for _, x in own]))
    crown = levels_of([trees[name][1][-1][0] for name in names])
    root = crown[-1][0]
    for s, name in enumerate(names):
        own, levels = trees[name]
        for i, (r, leaf) in enumerate(own):
            steps = [*way(levels, i), *way(crown, s)]
            bad = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 2 == 0
            node = plain_leaf(r, r.text.replace("\n", "")) if bad and r.text is not None else leaf
            for a, b in steps:
                node = digest(a + node + b)
            yield (r.doc_id, leaf, levels[-1][0], root, digest("".join(a + b for a, b in steps)), node, node == root)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def some(spark):
    sizes = {"s0": 61, "s1": 1, "S": 2, "é": 3, "z": 9, "": 10, None: 28, **{f"t{k}": 1 for k in range(7)}}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            at += 1
            text = prose(at, 5).replace(" ", "\n", 2) if at % 3 else prose(at, 5)
            rows.append((at * 7 % 401, text, "a", source))
    rows += [(5, None, None, "s0"), (5, None, None, "s0"), (None, "x\ny", "a", "s0"), (None, "x\ny", "a", "s0"), (6, "", "a", "s1")]
    return documents(spark, rows, extra=True)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_proofs_equal_the_whole_tree(spark, levels):
    docs = some(spark).cache()
    built = manifest.build_manifest(docs, manifest.without_line_feeds(), manifest.ManifestOptions(levels))
    got = [tuple(r[c] for c in COLUMNS) for r in manifest.prove(built).collect()]
    want = list(brute(docs.collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 3])
def test_the_log_is_in_completion_order(spark, levels):
    docs = some(spark)
    built = manifest.build_manifest(docs, options=manifest.ManifestOptions(levels))
    logs = {}
    for r in built.log().collect():
        logs.setdefault(r.source, []).append(r)
    for log in logs.values():
        log.sort(key=lambda r: r.position)
        assert [r.position for r in log] == list(range(len(log)))
        leaves = [r.digest for r in log if r.level == 0]
        whole = list(manifest.append_log(leaves, 0, 0, manifest.height(len(leaves))))
        assert [(r.level, r.idx, r.digest) for r in log] == whole
    assert all(r.verified for r in manifest.prove(built).collect())


def test_positions_of_every_size():
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        order = list(manifest.append_log(["x"] * n, 0, 0, manifest.height(n)))
        found = [int(manifest.positions(level, np.array([idx]), n)[0]) for level, idx, _ in order]
        assert found == list(range(len(order)))


def test_awkward_tables(spark):
    docs = documents(spark, extra=True).cache()
    got = manifest.prove(manifest.build_manifest(docs, manifest.without_line_feeds())).collect()
    assert sorted([tuple(r[c] for c in COLUMNS) for r in got], key=repr) == sorted(brute(docs.collect()), key=repr)
    empty = manifest.build_manifest(documents(spark, []))
    assert empty.root is None and manifest.prove(empty).count() == 0
    (one,) = manifest.prove(manifest.build_manifest(documents(spark, [(1, "x", "a", "s")]))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest("")
