"""Cosine similarity of incoming vectors with the reader's own vectors.

The own set is packed once into a matrix of unit rows. While it is small enough (`OWN_BYTES`,
checked against its real row count and width) it is broadcast, and each Arrow batch of incoming
vectors is multiplied with it where it lies: nothing is shuffled.

Beyond that size the own set is cut into groups: around each of a bounded number of leaders, which are own
vectors themselves, rings by the angle to the leader. On the sphere the angle to any vector of a ring is at least
that to the leader, less (or, within the ring, short of) the ring's own, which bounds the cosine. An incoming
vector is sent only to groups whose bound reaches what it has already found: first its cosines with
the leaders, which take no shuffle, then the most promising group, then the others still worth it. Large groups are
split into tiles of bounded size on both sides, so neither a large group nor a popular one is one task, and small ones
share a tile, to which a vector is sent once however many of its groups are worth a visit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from marginalia.session import staged

OWN_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
#: Vectors on either side of a tile, in bytes as DOUBLE, unless the own set may be larger in one piece.
TILE_BYTES = 4 * 1024 * 1024
#: Leaders at most, the own vectors they are chosen from, and the rings around each.
LEADERS = 256
SAMPLE = 4096
RINGS = 16
#: What rounding may change an angle by.
ANGLE_ERROR = 1e-7


def _kernel(block_bytes: int = BLOCK_BYTES) -> tuple[Callable, Callable]:
    """The two numpy helpers that tasks need, as closures that carry no import of this package."""

    def unit_rows(vectors) -> np.ndarray:
        """ARRAY<FLOAT|DOUBLE> batch to a DOUBLE matrix of unit rows; zero rows stay zero."""
        import numpy as np
        import pyarrow as pa

        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        flat = vectors.flatten()
        if vectors.null_count or flat.null_count:
            raise ValueError("a vector, or an element of one, is NULL")
        widths = np.unique(np.diff(vectors.offsets.to_numpy()))
        if len(widths) > 1:
            raise ValueError(f"vector widths differ: {widths.tolist()}")
        width = int(widths[0]) if len(widths) else 0
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
        if not np.isfinite(matrix).all():
            raise ValueError("a vector contains NaN or infinity")
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)

    def products(new: np.ndarray, mine: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of new @ mine.T of bounded size, with the offset of their first column."""
        if new.shape[0] and new.shape[1] != mine.shape[1]:
            raise ValueError(f"vector widths differ: {new.shape[1]} and {mine.shape[1]}")
        step = max(1, block_bytes // (8 * max(1, new.shape[0])))
        for at in range(0, mine.shape[0], step):
            yield at, new @ mine[at : at + step].T

    return unit_rows, products


def _own_size(mine: DataFrame) -> tuple[int, int]:
    """(bytes, bytes per row) of the own set as DOUBLE. Runs a job; an empty set is an error."""
    facts = mine.agg(F.count("vec").alias("rows"), F.max(F.size("vec")).alias("width")).first()
    if not facts.rows:
        raise ValueError("the own set is empty: there is nothing to compare with")
    row = 8 * max(1, facts.width)
    return facts.rows * row, row


@dataclass(frozen=True)
class Groups:
    """The own set in groups; the arrays have one place for each, in order of `ids`."""

    leaders: np.ndarray
    own: DataFrame  # my_key, my_vec, _group
    ids: np.ndarray  # leader * RINGS + ring, or -1 for vectors of length zero
    low: np.ndarray  # the smallest and largest angle to the leader
    high: np.ndarray
    rows: np.ndarray


def _leaders(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit rows of which each is as far as can be from those chosen before it."""
    sample = sample[np.any(sample != 0, axis=1)]
    if not len(sample):
        return sample
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(many, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def group_own(mine: DataFrame, leaders: int) -> Groups:
    """Assign every own vector to its nearest leader and a ring. Runs jobs; the leaders come from a bounded sample."""
    unit_rows, _ = _kernel()
    sample = mine.select("key", "vec").orderBy(F.xxhash64("key", F.lit("leader"))).limit(SAMPLE).select("vec").toArrow()
    chosen = _leaders(unit_rows(sample.column("vec")), leaders)
    sent = mine.sparkSession.sparkContext.broadcast(chosen)
    rings = RINGS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column("my_vec"))
            group, angle = np.full(len(rows), -1), np.full(len(rows), np.pi / 2)
            there = np.any(rows != 0, axis=1)
            if there.any():
                near = rows[there] @ sent.value.T
                angle[there] = np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
                ring = np.minimum((angle[there] / np.pi * rings).astype(np.int64), rings - 1)
                group[there] = near.argmax(axis=1) * rings + ring
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(angle)], names=[*batch.schema.names, "_group", "_angle"])

    kept = mine.select(F.col("key").alias("my_key"), F.col("vec").alias("my_vec"))
    schema = StructType([*kept.schema.fields, StructField("_group", LongType()), StructField("_angle", DoubleType())])
    own = staged(kept.mapInArrow(assign, schema), "own-groups")
    facts = own.groupBy("_group").agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("rows")).toArrow()
    ids, low, high, rows = (facts.column(c).to_numpy() for c in ("_group", "low", "high", "rows"))
    return Groups(chosen, own.drop("_angle"), ids, low, high, rows)


def shared_tiles(groups: Groups, tile_rows: int) -> np.ndarray:
    """For each group the first id of the groups it shares tiles with: neighbours, as long as they fit into one."""
    order = np.argsort(groups.ids)
    sets, held = np.empty_like(groups.ids), tile_rows
    for at in order:
        if held + groups.rows[at] > tile_rows:
            first, held = groups.ids[at], 0
        sets[at], held = first, held + groups.rows[at]
    return sets


def choose_groups(new: DataFrame, groups: Groups, floor: float | None = None, sets: np.ndarray | None = None) -> DataFrame:
    """Add to (vec, ...) `_best`, the best cosine with a leader, and the groups worth a visit.

    `_groups` and `_bounds` hold the groups whose bound reaches `floor`, or exceeds `_best` if there is no floor,
    the most promising first; with `sets`, the id of the set of each group, they hold sets and the largest bound in each.
    A vector of length zero has cosine 0 with everything.
    """
    unit_rows, _ = _kernel()
    sets = groups.ids if sets is None else sets
    by_set = np.argsort(sets, kind="stable")
    names, starts = np.unique(sets[by_set], return_index=True)
    facts = (groups.leaders, groups.ids[by_set], groups.low[by_set], groups.high[by_set], names, starts)
    sent = new.sparkSession.sparkContext.broadcast(facts)
    rings, error = RINGS, ANGLE_ERROR

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        leaders, ids, low, high, names, starts = sent.value
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                rows = unit_rows(batch.column("vec"))
                if len(leaders) and rows.shape[1] != leaders.shape[1]:
                    raise ValueError(f"vector widths differ: {rows.shape[1]} and {leaders.shape[1]}")
                there = np.any(rows != 0, axis=1)
                near = rows @ leaders.T if len(leaders) else np.zeros((len(rows), 1))
                angle = np.arccos(np.clip(near, -1.0, 1.0))[:, np.maximum(ids, 0) // rings]
                gap = np.maximum(np.maximum(angle - high, low - angle) - error, 0.0)
                bound = np.maximum.reduceat(np.where((ids >= 0) & there[:, None], np.cos(gap), 0.0), starts, axis=1)
                best = near.max(axis=1) if len(leaders) else np.full(len(rows), -np.inf)
                worth = bound >= floor if floor is not None else bound > best[:, None]
                picked = [np.flatnonzero(w) for w in worth]
                picked = [p[np.argsort(-b[p], kind="stable")] for p, b in zip(picked, bound, strict=True)]
                lists = (pa.array([values.tolist() for values in made], kind) for made, kind in (
                    ([names[p] for p in picked], pa.list_(pa.int64())), ([b[p] for p, b in zip(picked, bound, strict=True)], pa.list_(pa.float64())),
                ))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), *lists], names=[*batch.schema.names, "_best", "_groups", "_bounds"])

    more = [StructField("_best", DoubleType()), StructField("_groups", ArrayType(LongType())), StructField("_bounds", ArrayType(DoubleType()))]
    return new.mapInArrow(choose, StructType([*new.schema.fields, *more]))


def _visit(visits: DataFrame, groups: Groups, sets: np.ndarray, reduce_rows: Callable, schema: StructType, tile_rows: int) -> DataFrame:
    """Run `reduce_rows` on every row of `visits` (vec, _group, ...) and every own vector of that set of groups.

    `sets` has the set of each group. A set is split into tiles of about `tile_rows` on either side. Own vectors of
    sets without a visit are not shuffled.
    """
    spark = visits.sparkSession
    unit_rows, _ = _kernel()
    kept = [c for c in visits.columns if c not in ("vec", "_group")]
    columns = [f.name for f in schema.fields]
    counts = {r._group: r["count"] for r in visits.groupBy("_group").count().collect()}
    sizes = [(int(g), ceil(int(groups.rows[sets == g].sum()) / tile_rows), ceil(counts[int(g)] / tile_rows)) for g in np.unique(sets) if int(g) in counts]
    plan = F.broadcast(spark.createDataFrame(sizes, "_group bigint, subs int, chunks int"))
    members = F.broadcast(spark.createDataFrame([*zip(groups.ids.tolist(), sets.tolist(), strict=True)], "_member bigint, _group bigint"))
    place = F.xxhash64(F.monotonically_increasing_id())

    def upto(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    own = groups.own.withColumnRenamed("_group", "_member").withColumn("_at", place).join(members, "_member").join(plan, "_group")
    own = own.select("my_key", "my_vec", "_group", F.pmod("_at", F.col("subs")).cast("int").alias("_sub"), upto("chunks").alias("_chunk"))
    asked = visits.withColumn("_at", place).join(plan, "_group")
    asked = asked.select(*kept, "vec", "_group", F.pmod("_at", F.col("chunks")).cast("int").alias("_chunk"), upto("subs").alias("_sub"))
    empty = spark.createDataFrame([], schema).toArrow()

    def with_tile(new_tile: pa.Table, own_tile: pa.Table) -> pa.Table:
        import pyarrow as pa

        if not new_tile.num_rows or not own_tile.num_rows:
            return empty
        my_keys, matrix = own_tile.column("my_key").combine_chunks(), unit_rows(own_tile.column("my_vec"))
        parts = [
            part
            for batch in new_tile.to_batches()
            for part in reduce_rows(batch.select(kept), unit_rows(batch.column("vec")), my_keys, matrix)
        ]
        return pa.Table.from_batches(parts).select(columns) if parts else empty

    return asked.groupBy("_group", "_sub", "_chunk").cogroup(own.groupBy("_group", "_sub", "_chunk")).applyInArrow(with_tile, schema)


def _broadcast_compare(new: DataFrame, mine: DataFrame, reduce_rows: Callable, schema: StructType) -> DataFrame:
    """Run `reduce_rows` on every batch of `new` and the whole own set, where the batch lies."""
    unit_rows, _ = _kernel()
    kept = [c for c in new.columns if c != "vec"]
    table = mine.select(F.col("key").alias("my_key"), "vec").toArrow()
    own = new.sparkSession.sparkContext.broadcast((table.column("my_key").combine_chunks(), unit_rows(table.column("vec"))))

    def with_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                my_keys, matrix = own.value
                yield from reduce_rows(batch.select(kept), unit_rows(batch.column("vec")), my_keys, matrix)

    return new.mapInArrow(with_broadcast, schema)


def _numbered(new: DataFrame) -> DataFrame:
    """`new` written once, with stable row numbers: it is read more than once and must not be encoded again."""
    return staged(new.withColumn("_row", F.monotonically_increasing_id()), "new-vectors")


def score_candidates(new: DataFrame, mine: DataFrame, own_bytes: int = OWN_BYTES, leaders: int | None = None) -> DataFrame:
    """Put `score`, the best cosine with any own vector, in place of `vec`.

    `new` has (key, vec) and columns that pass through, `mine` has (key, vec). Only one number
    per incoming vector leaves a task, never the pairs. A zero vector scores 0; NaN, infinity,
    NULL and unequal widths are errors, and so is an empty own set. Runs a job to learn the size
    of `mine`, and more if that is above `own_bytes`; by then there are as many leaders as a plain grid would
    have blocks, unless `leaders` tells.
    """
    _, products = _kernel()

    def best(rows, vectors, my_keys, matrix) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        score = np.full(vectors.shape[0], -np.inf)
        for _, block in products(vectors, matrix):
            np.maximum(score, block.max(axis=1), out=score)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, "score"])

    kept = new.drop("vec")
    size, row = _own_size(mine)
    if size <= own_bytes:
        return _broadcast_compare(new, mine, best, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
    groups = group_own(mine, leaders or min(LEADERS, ceil(size / own_bytes)))
    tile_rows = max(1, max(own_bytes, TILE_BYTES) // row)
    sets = shared_tiles(groups, tile_rows)
    chosen = staged(choose_groups(_numbered(new), groups, sets=sets), "chosen-groups")
    schema = StructType([StructField("_row", LongType()), StructField("score", DoubleType())])

    def found(visits: DataFrame) -> DataFrame:
        scores = _visit(visits.select("_row", "vec", "_group"), groups, sets, best, schema, tile_rows)
        return staged(scores.groupBy("_row").agg(F.max("score").alias("score")), "visited-groups")

    first = found(chosen.where(F.size("_groups") > 0).withColumn("_group", F.get("_groups", F.lit(0))))
    known = chosen.join(first, "_row", "left").withColumn("_best", F.greatest("_best", "score")).drop("score")
    others = F.explode(F.slice(F.arrays_zip("_groups", "_bounds"), 2, max(1, len(np.unique(sets))))).alias("x")
    worth = known.where(F.size("_groups") > 1).select("_row", "vec", "_best", others).where("x._bounds > _best")
    second = found(worth.withColumn("_group", F.col("x._groups")))
    whole = known.join(second, "_row", "left")
    return whole.select(*kept.columns, F.greatest("_best", "score").alias("score"))


def cosine_pairs(new: DataFrame, mine: DataFrame, floor: float, own_bytes: int = OWN_BYTES, leaders: int | None = None) -> DataFrame:
    """(key, my_key, sim) for every pair with `sim >= floor`.

    The dense matrix exists only block by block inside a task. A low floor emits most of
    |new| x |mine| pairs; where only the maxima are wanted, `score_candidates` gives them without. Same errors and same job as `score_candidates`.
    """
    _, products = _kernel()

    def keep(rows, vectors, my_keys, matrix) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        keys = rows.column("key")
        for at, block in products(vectors, matrix):
            i, j = np.nonzero(block >= floor)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), my_keys.take(pa.array(j + at)), pa.array(block[i, j])], names=["key", "my_key", "sim"])

    new = new.select("key", "vec")
    schema = StructType([new.schema["key"], StructField("my_key", mine.schema["key"].dataType), StructField("sim", DoubleType())])
    size, row = _own_size(mine)
    if size <= own_bytes:
        return _broadcast_compare(new, mine, keep, schema)
    groups = group_own(mine, leaders or min(LEADERS, ceil(size / own_bytes)))
    tile_rows = max(1, max(own_bytes, TILE_BYTES) // row)
    sets = shared_tiles(groups, tile_rows)
    chosen = staged(choose_groups(new, groups, floor, sets), "chosen-groups")
    visits = chosen.select("key", "vec", F.explode("_groups").alias("_group"))
    return _visit(visits, groups, sets, keep, schema, tile_rows)


def max_similarity(pairs: DataFrame) -> DataFrame:
    """(key, my_key, sim) to (key, score): the maximum per key; NaN wins, as in numpy."""
    return pairs.groupBy("key").agg(F.max("sim").alias("score"))
