"""Merkle manifest of a dataset, kept as postorder append logs.

Every source is a tree over its rows in order of their id, every three consecutive nodes having a parent
until one is left; the sources' tops are the leaves of one more tree, whose top is the root.

A tree's nodes form a log in the order in which they are complete: a node comes right after its last
child. Its position therefore follows from its level and number alone: all that is complete before its
first leaf, and its own subtree. So builders of aligned blocks (3 ** levels consecutive nodes) need not
know of each other: each writes its part of the log at its final positions, and the blocks' tops are what
the next round of builders works on. A proof is read the same way, by computing where the siblings stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import staged

ARITY = 3
#: Powers of the arity that a long holds.
POWERS = [ARITY**t for t in range(40)]
#: The columns of a leaf in the order in which they are hashed.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LOG_SCHEMA = "tree bigint, n bigint, block bigint, level int, idx bigint, position bigint, digest string"
PATH_SCHEMA = "tree bigint, block bigint, left array<string>, right array<string>, subroot string"


@dataclass(frozen=True)
class ManifestOptions:
    levels: int = 8  # levels that one builder completes; it holds at most 3 ** levels nodes


@dataclass
class Manifest:
    """Staged tables of a built manifest; `root` is None for an empty table."""

    leaves: DataFrame  # tree, n, idx, block, doc_id, digest, suspect
    sources: DataFrame  # source, tree, n
    rounds: list[DataFrame]  # the parts of the sources' logs, by round of builders
    top_rounds: list[DataFrame]  # the same of the tree over the sources
    root: str | None
    options: ManifestOptions = field(default_factory=ManifestOptions)

    def log(self) -> DataFrame:
        """(source, position, level, idx, digest): the whole log of every source."""
        every = self.rounds[0]
        for r, part in enumerate(self.rounds[1:], 1):
            # A block's top is already in the log of the round that completed it.
            every = every.unionByName(part.where(F.col("level") > r * self.options.levels))
        return every.join(self.sources.select("tree", "source"), "tree").select("source", "position", "level", "idx", "digest")


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree over n of them."""
    return next(t for t, power in enumerate(POWERS) if power >= n)


def _block(levels: int) -> Column:
    return F.expr(f"idx div {POWERS[levels]}").alias("block")


def _height(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def positions(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Where nodes (level, idx) stand in the log of a tree over n leaves, from 0."""
    first = idx * POWERS[level]
    size = np.minimum(POWERS[level], n - first)
    before = sum((first // power for power in POWERS if power <= n), np.zeros_like(first))
    return before + sum((-(-size // power) for power in POWERS[: level + 1]), np.zeros_like(first)) - 1


def append_log(digests: list[str], first: int, base: int, top: int) -> Iterator[tuple[int, int, str]]:
    """(level, idx, digest) of all nodes over consecutive nodes of level `base`, in order of completion.

    `first` is the number of the first one; it is aligned, so no parent has children elsewhere. What the last
    nodes leave incomplete is completed by them alone, up to level `top`.
    """
    waiting: list[list[str]] = [[] for _ in range(top - base + 1)]
    done = [first // POWERS[t] for t in range(top - base + 1)]

    def complete(t: int, digest: str) -> Iterator[tuple[int, int, str]]:
        yield base + t, done[t], digest
        done[t] += 1
        waiting[t].append(digest)
        if len(waiting[t]) == ARITY and t < top - base:
            yield from close(t)

    def close(t: int) -> Iterator[tuple[int, int, str]]:
        made = hexdigest("".join(waiting[t]))
        waiting[t].clear()
        yield from complete(t + 1, made)

    for digest in digests:
        yield from complete(0, digest)
    for t in range(top - base):
        if waiting[t]:
            yield from close(t)


def _builder(base: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """Write one block's part of the log, at its final positions."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, n, block, first = (table.column(c)[0].as_py() for c in ("tree", "n", "block", "idx"))
        top = min(base + levels, height(n))
        nodes = append_log(table.column("digest").to_pylist(), first, base, top)
        level, idx, digest = map(list, zip(*nodes, strict=True))
        numbers, kinds = np.array(idx, np.int64), np.array(level, np.int32)
        at = np.zeros(len(level), np.int64)
        for t in range(base, top + 1):
            at[kinds == t] = positions(t, numbers[kinds == t], n)
        same = [np.full(len(level), value, np.int64) for value in (tree, n, block)]
        columns = [*same, kinds, numbers, at, pa.array(digest, pa.string())]
        return pa.table([pa.array(c) for c in columns], names=["tree", "n", "block", "level", "idx", "position", "digest"])

    return build


def _build(nodes: DataFrame, deepest: int, levels: int, name: str) -> list[DataFrame]:
    """The log of every tree in rounds; `nodes` (tree, n, idx, digest) are the leaves of all trees.

    A round completes `levels` levels. Its groups are aligned blocks, bounded whatever the size of a tree.
    """
    rounds: list[DataFrame] = []
    base = 0
    while True:
        blocks = nodes.select("tree", "n", "idx", "digest", _block(levels)).groupBy("tree", "block")
        rounds.append(staged(blocks.applyInArrow(_builder(base, levels), LOG_SCHEMA), f"{name}-log"))
        base += levels
        if base >= deepest:
            return rounds
        nodes = rounds[-1].where((F.col("level") == base) & (_height(F.col("n")) > base))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, subroot): the last node of every tree's log."""
    found = [part.where(F.col("level") == _height(F.col("n"))).select("tree", F.col("digest").alias("subroot"), "n") for part in rounds]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _siblings(nodes: pa.Table, log: pa.Table, base: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each of `nodes` (by idx) and each level of its block: the digests left and right of it in its run."""
    n = log.column("n")[0].as_py()
    at = log.column("position").to_numpy()
    order = np.argsort(at)
    at, digests = at[order], log.column("digest").take(pa.array(order)).to_pylist()
    own = nodes.column("idx").to_numpy()
    found: list[list[tuple[str, str]]] = [[] for _ in range(len(own))]
    for level in range(base, min(base + levels, height(n))):
        idx = own // POWERS[level - base]
        first = idx - idx % ARITY
        count = -(-n // POWERS[level])
        runs, run_of = np.unique(first, return_inverse=True)
        members = [positions(level, runs + k, n) for k in range(ARITY)]
        places = [np.searchsorted(at, np.where(runs + k < count, members[k], at[-1])) for k in range(ARITY)]
        texts = [[digests[p] if f + k < count else "" for p, f in zip(places[k].tolist(), runs.tolist(), strict=True)] for k in range(ARITY)]
        for node, (run, slot) in enumerate(zip(run_of.tolist(), (idx - first).tolist(), strict=True)):
            run_texts = [texts[k][run] for k in range(ARITY)]
            found[node].append(("".join(run_texts[:slot]), "".join(run_texts[slot + 1 :])))
    return found


def _log_and_uppers(log: DataFrame, uppers: DataFrame) -> DataFrame:
    """What a block's reader needs: its part of the log, and one row with the way from its top to the root."""
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "bigint"), ("position", "bigint"), ("digest", "string"))]
    way = uppers.select("tree", "block", *nothing, "left", "right", "subroot")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("left", "array<string>"), ("right", "array<string>"), ("subroot", "string"))]
    return log.select("tree", "block", "n", "position", "digest", *none).unionByName(way)


def _split(right: pa.Table) -> tuple[pa.Table, list[str], list[str], str | None]:
    way = right.filter(pc.is_null(right.column("position"))).to_pylist()[0]
    return right.filter(pc.is_valid(right.column("position"))), way["left"], way["right"], way["subroot"]


def _ways(rounds: list[DataFrame], r: int, levels: int, uppers: DataFrame, name: str) -> DataFrame:
    """PATH_SCHEMA rows for the nodes that round r starts from; `uppers` are those of its blocks' tops."""

    def read(nodes: pa.Table, right: pa.Table) -> pa.Table:
        log, left, right_, subroot = _split(right)
        nodes = nodes.sort_by("idx")
        rows = [
            (tree, idx, [a for a, _ in own] + left, [b for _, b in own] + right_, subroot)
            for tree, idx, own in zip(nodes.column("tree").to_pylist(), nodes.column("idx").to_pylist(), _siblings(nodes, log, r * levels, levels), strict=True)
        ]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        columns = zip(*rows, strict=True)
        names = ("tree", "block", "left", "right", "subroot")
        return pa.table({n: pa.array(list(c), kind) for n, c, kind in zip(names, columns, kinds, strict=True)})

    nodes = rounds[r].where(F.col("level") == r * levels).select("tree", "block", "idx")
    both = nodes.groupBy("tree", "block").cogroup(_log_and_uppers(rounds[r], uppers).groupBy("tree", "block"))
    return staged(both.applyInArrow(read, PATH_SCHEMA), f"{name}-ways")


def _uppers(rounds: list[DataFrame], r: int, levels: int, tops: DataFrame, ways: DataFrame | None) -> DataFrame:
    """PATH_SCHEMA rows of the blocks of round r: `tops` where a tree ends in it, else `ways` of the next round."""
    ends = _height(F.col("n")) <= (r + 1) * levels
    begins = _height(F.col("n")) > r * levels if r else F.lit(True)
    here = tops.where(ends & begins).select("tree", F.lit(0).cast("bigint").alias("block"), "left", "right", "subroot")
    return here if ways is None else here.unionByName(ways)


def field_text(value: Column) -> Column:
    """`-` for null, else the value with its UTF-8 byte count before it."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, or of the row with another text."""
    values = [F.col(c) for c in LEAF_COLUMNS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(field_text, values)), 256)


def _counted_before(parts: DataFrame, of: list[str]) -> DataFrame:
    """Add `before`: the rows of earlier parts (of the same `of`)."""
    window = W.partitionBy(*of).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("rows").over(window), F.lit(0)))


def build_manifest(docs: DataFrame, suspect: Column | None = None, options: ManifestOptions = ManifestOptions()) -> Manifest:
    """Hash every row and build the logs of all sources and of the tree over them.

    `suspect` is a leaf digest to be tested later in place of the row's own, null for its own. Rows of a source
    are ordered by doc_id (null first), then by digest, so repeated rows are leaves of their own. Null values
    are hashed as null and a null source is a source. A text is hashed where it is read; only digests travel.
    Columns other than LEAF_COLUMNS are not read, whatever their names. An empty table has no leaves and no
    root. No group is larger than a block, so neither a hot source nor many sources matter.
    """
    narrow = docs.select(
        "doc_id", "source", leaf().alias("digest"), (F.lit(None).cast("string") if suspect is None else suspect).alias("suspect"),
        F.monotonically_increasing_id().alias("row"),
    )
    # A sort deals ranges to tasks; numbering needs but the row counts of each range.
    ordered = staged(narrow, "manifest-rows").orderBy(F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "digest", "row")
    ordered = staged(ordered.drop("row").withColumn("at", F.monotonically_increasing_id()), "manifest-sorted")
    ordered = ordered.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).withColumn("part", F.shiftright("at", 33))
    parts = staged(ordered.groupBy("part", "key", "source").agg(F.min("at").alias("start"), F.count("*").alias("rows")), "manifest-parts")

    named = parts.groupBy("key", "source").agg(F.sum("rows").alias("n")).orderBy(F.col("source").asc_nulls_first())
    named = staged(named.withColumn("at", F.monotonically_increasing_id()), "manifest-names").withColumn("part", F.shiftright("at", 33))
    spans = named.groupBy("part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    spans = _counted_before(spans, []).select("part", (F.col("before") - F.col("start")).alias("shift"))
    sources = staged(named.join(spans, "part").select("key", "source", "n", (F.col("at") + F.col("shift")).alias("tree")), "manifest-sources")

    shifts = _counted_before(parts, ["key"]).join(sources.select("key", "tree", "n"), "key")
    shifts = staged(shifts.select("part", "key", "tree", "n", (F.col("before") - F.col("start")).alias("shift")), "manifest-shifts")
    leaves = ordered.join(shifts, ["part", "key"]).withColumn("idx", F.col("at") + F.col("shift"))
    leaves = staged(leaves.select("tree", "n", "idx", _block(options.levels), "doc_id", "digest", "suspect"), "manifest-leaves")

    sizes = sources.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()
    rounds = _build(leaves, height(sizes.n or 1), options.levels, "manifest")
    tops = _tops(rounds)
    crown = tops.select(F.lit(0).cast("bigint").alias("tree"), F.lit(sizes.trees).cast("bigint").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    top_rounds = _build(crown, height(max(sizes.trees, 1)), options.levels, "manifest-top")
    root = _tops(top_rounds).first()
    return Manifest(leaves, sources, rounds, top_rounds, root.subroot if root else None, options)


def _source_ways(manifest: Manifest) -> DataFrame:
    """(tree, n, left, right, subroot): the way of every source's top to the root."""
    levels, rounds = manifest.options.levels, manifest.top_rounds
    none = F.array().cast("array<string>")
    tops = _tops(rounds).select("tree", "n", none.alias("left"), none.alias("right"), "subroot")
    ways: DataFrame | None = None
    for r in reversed(range(len(rounds))):
        ways = _ways(rounds, r, levels, _uppers(rounds, r, levels, tops, ways), "manifest-top")
    by_tree = ways.select(F.col("block").alias("tree"), "left", "right")
    return staged(_tops(manifest.rounds).join(by_tree, "tree"), "manifest-tops")


def prove(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, proof_sha256, folded_root, verified) of every row.

    `siblings` holds the proof, level by level from the leaf to the root. `folded_root` is what the siblings
    make of the suspect digest, or of the row's own where there is none.
    """
    levels, rounds, root = manifest.options.levels, manifest.rounds, manifest.root
    tops = _source_ways(manifest)
    ways: DataFrame | None = None
    for r in reversed(range(1, len(rounds))):
        ways = _ways(rounds, r, levels, _uppers(rounds, r, levels, tops, ways), "manifest")

    def read(rows: pa.Table, right: pa.Table) -> pa.Table:
        log, left, right_, subroot = _split(right)
        rows = rows.sort_by("idx")
        upper = list(zip(left, right_, strict=True))
        proofs, folded = [], []
        suspects = pc.coalesce(rows.column("suspect"), rows.column("digest")).to_pylist()
        for node, own in zip(suspects, _siblings(rows, log, 0, levels), strict=True):
            way = own + upper
            for a, b in way:
                node = hexdigest(a + node + b)
            proofs.append("".join(a + b for a, b in way))
            folded.append(node)
        return pa.table({
            "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": pa.array([subroot] * len(rows), pa.string()),
            "root": pa.array([root] * len(rows), pa.string()), "siblings": pa.array(proofs, pa.string()),
            "proof_sha256": pa.array(list(map(hexdigest, proofs)), pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        })

    schema = "doc_id bigint, leaf string, subroot string, root string, siblings string, proof_sha256 string, folded_root string, verified boolean"
    block = manifest.leaves.select("tree", "block", "idx", "doc_id", "digest", "suspect").groupBy("tree", "block")
    both = block.cogroup(_log_and_uppers(rounds[0], _uppers(rounds, 0, levels, tops, ways)).groupBy("tree", "block"))
    return both.applyInArrow(read, schema)


def without_line_feeds(modulus: int = 2) -> Column:
    """The leaf of a tampered row, null where `modulus` does not divide the crc32 of its id: its text loses all line feeds."""
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == 0
    return F.when(tampered, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
