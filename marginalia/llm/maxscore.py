"""Exact top-k search by inner product with MaxScore.

A vector's components are the terms of a document, and a shard holds one posting list a term. What a term can
add to a query's score at most follows from the largest and smallest value of its list. Terms are taken from the
largest of these bounds down; those whose bounds together stay below the k-th best score known are not
essential: no vector gets in by them alone. So only the essential lists are traversed whole. What they give, with
the bound of the rest, decides which vectors are probed in further lists, a few lists at a time, for as
long as they can compete. Bounds never cut a score that is equal to the k-th, so results are exact.

A bounded sample of the vectors is searched first; the k-th score found there starts the search of all
other shards. Queries meet shards in tiles of bounded size; the shards' best rows are merged in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import give_back_memory
from marginalia.session import staged

#: Sums of products below this are exact in double precision.
EXACT = 2.0**53
FOUND_SCHEMA = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
FOUND = pa.schema([(name, pa.int64()) for name in ("query", "query_id", "row", "vec_id", "score")])


@dataclass(frozen=True)
class SearchOptions:
    k: int = 5
    seeds: int = 4096  # vectors, about, that are searched first for starting thresholds
    shard_rows: int = 65_536  # vectors of a shard at most, about
    least_rows: int = 2048  # no shard is cut smaller than this only to keep all cores busy
    block_queries: int = 16_384  # queries of a tile at most, about
    probe: int = 8  # lists that are probed between two looks at who can still compete


class Shard:
    """Posting lists of some vectors, with the largest and smallest value of each."""

    def __init__(self, vectors: list[np.ndarray], width: int) -> None:
        self.lists = np.zeros((width, len(vectors)))
        for at, vector in enumerate(vectors):
            self.lists[: len(vector), at] = vector
        self.high = np.maximum(self.lists.max(axis=1, initial=0.0), 0.0)
        self.low = np.minimum(self.lists.min(axis=1, initial=0.0), 0.0)
        self.visited = 0

    def best(self, query: np.ndarray, threshold: float, k: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all vectors that can be among the k best and reach the threshold."""
        most = np.maximum(query * self.high, query * self.low)
        least = np.minimum(query * self.high, query * self.low)
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        short = np.append(np.cumsum(least[order][::-1])[::-1], 0.0)
        essential = int(np.argmax(rest < threshold)) if rest[-1] < threshold else len(order)
        own = order[:essential]
        scores = query[own] @ self.lists[own]
        places = np.arange(len(scores))
        self.visited += essential * len(places)
        at = essential
        while True:
            if len(places) > k:
                sure = scores + short[at]
                threshold = max(threshold, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
            alive = scores + rest[at] >= threshold
            places, scores = places[alive], scores[alive]
            if at == len(order) or not len(places):
                return places, scores
            few = order[at : at + probe]
            scores = scores + query[few] @ self.lists[np.ix_(few, places)]
            self.visited += len(few) * len(places)
            at += len(few)


def _whole(vector: list[float]) -> np.ndarray:
    return np.floor(256.0 * np.array(vector, dtype=np.float64))


def _exact(vectors: list[np.ndarray], query: np.ndarray) -> list[int]:
    """Scores in whole numbers of any size."""
    own = list(map(int, query))
    return [sum(a * b for a, b in zip(own, map(int, vector), strict=False)) for vector in vectors]


def search_tile(options: SearchOptions) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query, query_id, row, vec_id, score) of the best vectors of a tile for each of its queries."""

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        values = [_whole(v) for v in vectors.column("embedding").to_pylist()]
        asked = [_whole(v) for v in queries.column("asked").to_pylist()]
        rows, ids = vectors.column("row").to_numpy(), vectors.column("vec_id").to_pylist()
        width = max(map(len, values + asked))
        reach = [max((float(np.abs(v).max(initial=0.0)) for v in side), default=0.0) for side in (values, asked)]
        shard = Shard(values, width) if reach[0] * reach[1] * max(width, 1) < EXACT else None
        found: list[tuple[int, int | None, int, int | None, int]] = []
        numbers, query_ids, starts = (queries.column(c).to_pylist() for c in ("query", "query_id", "threshold"))
        for number, query_id, own, start in zip(numbers, query_ids, asked, starts, strict=True):
            if shard is None:
                scores = _exact(values, own)
                places = range(len(scores))
            else:
                # The query itself may be among the vectors of the tile, so one more than k is asked for.
                padded = np.append(own, np.zeros(width - len(own)))
                at, sums = shard.best(padded, -np.inf if start is None else float(start), options.k + 1, options.probe)
                places, scores = at.tolist(), sums.astype(np.int64).tolist()
            hits = [(-s, ids[p] is None, ids[p] or 0, int(rows[p]), ids[p]) for p, s in zip(places, scores, strict=True) if rows[p] != number]
            hits.sort()
            found += [(number, query_id, row, vec_id, -s) for s, _, _, row, vec_id in hits[: options.k]]
        give_back_memory()
        columns = zip(*found, strict=True) if found else [[]] * len(FOUND)
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], schema=FOUND)

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors for every row for which `is_query` holds.

    The score is the inner product of floor(256 * x) of all components; ties go to the smaller vec_id, a null id
    last. Vectors that are null or hold null or non-finite components (or such whose 256-fold is not finite) take
    no part; missing components of a shorter vector count as 0. Repeated rows are vectors of their own, and each
    finds the others. A query with fewer than k other vectors gets all of them, an empty table gives no rows, and
    a score beyond a long is an error. Only vec_id and embedding are read, whatever else there is.
    """
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(256.0 * x) < float("inf")))
    vectors = (
        embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.col("embedding").isNotNull() & finite)
        .withColumn("row", F.monotonically_increasing_id())
    )
    vectors = staged(vectors, "search-vectors")
    size = vectors.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    n = max(size.n, 1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = min(options.shard_rows, max(options.least_rows, n // (2 * cores)))
    shards, blocks = -(-n // rows), max(-(-size.asks // options.block_queries), 1)

    place = F.pmod(F.xxhash64("row"), F.lit(n))
    shard = F.when(place < options.seeds, 0).otherwise(1 + F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(shards)))
    every_block = F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")
    tiles = vectors.select(shard.cast("bigint").alias("shard"), every_block, "row", "vec_id", "embedding")
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("bigint").alias("block")
    asked = [F.col(c).alias(name) for c, name in (("row", "query"), ("vec_id", "query_id"), ("embedding", "asked"))]
    queries = vectors.where("asks").select(block, *asked)

    def searched(part: DataFrame, with_starts: DataFrame) -> DataFrame:
        left = part.groupBy("shard", "block")
        right = with_starts.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block"), "*").drop("shard", "block")
        right = right.groupBy("to_shard", "to_block")
        return left.cogroup(right).applyInArrow(search_tile(options), FOUND_SCHEMA)

    unstarted = queries.select(F.lit(0).cast("bigint").alias("shard"), "*", F.lit(None).cast("bigint").alias("threshold"))
    first = staged(searched(tiles.where("shard = 0"), unstarted), "search-seeds")
    start = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("threshold"))
    start = staged(start.where(F.col("n") >= options.k).select("query", "threshold"), "search-starts")
    every_shard = F.explode(F.expr(f"sequence(1L, {shards}L)")).alias("shard")
    started = queries.join(start, "query", "left").select(every_shard, "block", "query", "query_id", "asked", "threshold")
    others = searched(tiles.where("shard > 0"), started)
    return _ranked(first.unionByName(others), options.k).select("query_id", "rank", "vec_id", "score")
