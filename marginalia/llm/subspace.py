"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least t lie within squared distance 2 (1 - t). A seeded rotation spreads the
distance evenly; the rotated vectors are cut into low-dimensional blocks, and each block gets the share
of the squared distance that its width is of the whole. By the pigeonhole principle a linked pair keeps
within the budget of at least one block. Each block is range-joined: cells are the sign patterns of its
leading coordinates, and a vector is a guest in every cell that its budget reaches. Candidates of
all blocks are united by counting a pair in the first block that admits it, and verified in double
precision. Rotated coordinates are rounded to integers first, so every task decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bytes_of, map_batches
from marginalia.llm.components import components
from marginalia.session import staged

#: Rotated coordinates of unit vectors are whole multiples of 1 / SCALE; sums of squares stay exact in doubles.
SCALE = float(1 << 20)
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


@dataclass(frozen=True)
class SubspaceOptions:
    cosine: float = 0.95
    block_width: int = 8
    seed: int = 17
    cell_rows: int = 2048  # vectors of a cell that the number of cells aims at; it plans, results do not depend on it
    tile_rows: int = 2048  # residents of a cell that meet in one task,
    guest_rows: int = 8192  # with so many of its guests


def rotation(width: int, seed: int) -> np.ndarray:
    if (width, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
        _ROTATIONS[width, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[width, seed]


def blocks_of(width: int, options: SubspaceOptions) -> list[np.ndarray]:
    return np.array_split(np.arange(width), max(1, width // options.block_width))


def budgets(width: int, options: SubspaceOptions) -> list[float]:
    """Squared distance that each block admits, in integer units, rounding of coordinates included."""
    whole = (np.sqrt(2 * (1 - options.cosine)) + 1e-5) ** 2
    return [np.ceil(whole * len(b) / width * SCALE * SCALE) for b in blocks_of(width, options)]


def rotated(vectors: np.ndarray, options: SubspaceOptions) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and their rotated integer coordinates."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return unit, np.rint(unit @ rotation(vectors.shape[1], options.seed) * SCALE)


def _dealt(reps: DataFrame, options: SubspaceOptions, bits: int, kind: str) -> DataFrame:
    """Rows (width, block, cell, guest, rep, copies, vec): each vector at home once a block, and as a guest.

    A guest goes to cells above its own only, so that two cells meet in one of them.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rep, copies, widths = (np.asarray(batch.column(c)) for c in ("rep", "copies", "width"))
        raw, bounds = bytes_of(batch.column("vec"))
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            size = int(width) * np.dtype(kind).itemsize
            data = raw[bounds[at][:, None] + np.arange(size)]
            _, spun = rotated(data.view(kind).astype(float), options)
            for b, (block, budget) in enumerate(zip(blocks_of(width, options), budgets(width, options), strict=True)):
                used = min(bits, len(block))
                lead = spun[:, block[:used]]
                home = ((lead >= 0) << np.arange(used)).sum(axis=1)
                masks = np.arange(1 << used)
                flips = (masks[:, None] >> np.arange(used) & 1).astype(float)
                cell = home[:, None] ^ masks
                reach = ((lead**2) @ flips.T <= budget) & ((cell > home[:, None]) | (masks == 0))
                who, mask = np.nonzero(reach)
                columns = (np.full(len(who), width), np.full(len(who), b), cell[who, mask], mask > 0, rep[at][who], copies[at][who])
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
                vec = pa.Array.from_buffers(
                    pa.large_binary(), len(who), [None, pa.py_buffer(np.arange(len(who) + 1, dtype=np.int64) * size), pa.py_buffer(data[who])]
                )
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [vec.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["width", "block", "cell", "guest", "rep", "copies", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                yield from work(batch.slice(start, 2000))

    return reps.mapInArrow(run, "width int, block int, cell int, guest boolean, rep bigint, copies bigint, vec binary")


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i[n] with j[n]; a label is the smallest index of its group."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(labels, ahead := labels[labels]):
            labels = ahead


def tile_links(left: np.ndarray, right: np.ndarray, block: int, same: bool, options: SubspaceOptions):  # noqa: ANN201
    """Yield (i, j) index arrays of the linked pairs that belong to `block`; i < j where both sides are the same."""
    width = left.shape[1]
    parts, limits = blocks_of(width, options), budgets(width, options)
    unit_l, spun_l = rotated(left, options)
    unit_r, spun_r = (unit_l, spun_l) if same else rotated(right, options)

    def distance(b: int, rows: slice) -> np.ndarray:
        x, y = spun_l[rows][:, parts[b]], spun_r[:, parts[b]]
        return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T)

    for start in range(0, len(left), 256):
        rows = slice(start, start + 256)
        admitted = distance(block, rows) <= limits[block]
        if same:
            admitted &= np.arange(len(right)) > np.arange(start, min(start + 256, len(left)))[:, None]
        n = int(admitted.sum())
        if not n:
            continue
        if n * 20 > admitted.size:
            for b in range(block):
                admitted &= distance(b, rows) > limits[b]
            admitted &= unit_l[rows] @ unit_r.T >= options.cosine
            i, j = np.nonzero(admitted)
        else:
            i, j = np.nonzero(admitted)
            gap = (spun_l[rows][i] - spun_r[j]) ** 2
            keep = np.einsum("nd,nd->n", unit_l[rows][i], unit_r[j]) >= options.cosine
            for b in range(block):
                keep &= gap[:, parts[b]].sum(axis=1) > limits[b]
            i, j = i[keep], j[keep]
        if len(i):
            yield i + start, j


def _tiled(dealt: DataFrame, options: SubspaceOptions) -> DataFrame:
    """Deal the rows of each cell to tiles of bounded size in which every pair meets once.

    A cell's residents are cut into chunks i, its guests into chunks j; tiles are pairs of different
    resident chunks i < j, and pairs of a resident and a guest chunk, of which the first one also compares
    the residents with each other. There are as many rows of counts as cells, a
    number the plan fixes, so they are broadcast. Cells without residents meet nobody.
    """
    key = ["width", "block", "cell"]
    counts = dealt.groupBy(*key).agg(F.count(F.when(~F.col("guest"), 1)).alias("own"), F.count(F.when(F.col("guest"), 1)).alias("visiting"))
    own, visiting = F.ceil(F.col("own") / options.tile_rows), F.ceil(F.col("visiting") / options.guest_rows)
    counts = counts.select(*key, own.cast("int").alias("own"), F.greatest(visiting, F.lit(1)).cast("int").alias("visiting"))
    counts = staged(counts.where("own > 0"), "subspace-cells")
    rows = dealt.join(F.broadcast(counts), key)
    own = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")
    visiting = F.pmod(F.xxhash64("rep"), F.col("visiting")).cast("int")
    tile = lambda i, j, guests, left: F.struct(i.alias("i"), j.alias("j"), F.lit(guests).alias("guests"), left.alias("left"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.filter(up_to(F.col("own")), lambda k: k != own)
    resident = F.concat(
        F.transform(others, lambda k: tile(F.least(own, k), F.greatest(own, k), False, own <= k)),
        F.transform(up_to(F.col("visiting")), lambda k: tile(own, k, True, F.lit(True))),
    )
    guest = F.transform(up_to(F.col("own")), lambda k: tile(k, visiting, True, F.lit(False)))
    return rows.select(*key, "rep", "copies", "vec", F.explode(F.when(F.col("guest"), guest).otherwise(resident)).alias("t")).select(
        *key, "t.*", "rep", "copies", "vec"
    )


def links(reps: DataFrame, options: SubspaceOptions, n: int, kind: str) -> DataFrame:
    """(rep, links, peer) from every tile: linked vectors counted, and a spanning forest of the links."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / options.cell_rows)), 0, options.block_width))
    tiles = _tiled(staged(_dealt(reps, options, bits, kind), "subspace-dealt"), options)

    def work(key: tuple, group: pa.Table) -> pa.Table:
        width, block, j, guests = (k.as_py() for k in (key[0], key[1], key[4], key[5]))
        left_side = np.asarray(group.column("left"))
        rep, copies = np.asarray(group.column("rep")), np.asarray(group.column("copies"))
        vectors = bytes_of(group.column("vec"))[0].view(kind).reshape(-1, width).astype(float)
        a, b = np.flatnonzero(left_side), np.flatnonzero(~left_side)
        total, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for other in ([a] if guests and j == 0 else []) + [b]:
            if not len(a) or not len(other):
                continue
            for x, y in tile_links(vectors[a], vectors[other], block, other is a, options):
                x, y = a[x], other[y]
                total += np.bincount(x, copies[y], len(rep)).astype(np.int64) + np.bincount(y, copies[x], len(rep)).astype(np.int64)
                labels = _merge(labels, x, y)
        some = np.flatnonzero(total)
        return pa.table({"rep": rep[some], "links": total[some], "peer": rep[labels[some]]})

    grouped = tiles.groupBy("width", "block", "cell", "i", "j", "guests")
    return staged(grouped.applyInArrow(work, "rep bigint, links bigint, peer bigint"), "subspace-links")


def near_duplicates(vectors: DataFrame, options: SubspaceOptions = SubspaceOptions()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Links are pairs of different ids with cosine of at least `options.cosine` in double precision.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id
    link with nothing. Vectors of different widths do not link. Equal vectors are one representative
    that counts as often as it has ids; rows that repeat as a whole count once and are all returned.
    """
    rows = vectors.select("vec_id", "embedding")
    kind = "<f4" if "array<float>" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    v = F.col("embedding")
    fine = (
        v.isNotNull()
        & F.col("vec_id").isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    fine = F.coalesce(fine, F.lit(False))
    good = rows.where(fine)
    reps = good.distinct().groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = staged(reps, "subspace-reps")

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [np.array(e, kind).tobytes() for e in batch.column("embedding").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("copies"), batch.column("width"), pa.array(data, pa.binary())], names=["rep", "copies", "width", "vec"]
        )

    sized = reps.select("rep", "copies", "embedding", F.size("embedding").alias("width"))
    found = links(map_batches(sized, packed, "rep bigint, copies bigint, width int, vec binary"), options, reps.count(), kind)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> peer").select(F.col("rep").alias("a"), F.col("peer").alias("b"))).toDF("rep", "component_id")
    told = reps.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    linked = good.join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
