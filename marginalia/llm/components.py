"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (a, b); the component is its smallest node.

    Each round points every node at its smallest neighbour, follows the pointers once more, and
    replaces the edges by those between different targets, so chains at least halve. Every round is
    written to the shared scratch folder, which cuts the lineage and survives lost executors. Minima
    combine before the shuffle; joins on a hub's id are plain equi-joins that adaptive execution splits.
    """
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "pointers")
        ahead = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jump = staged(point.join(ahead, "to").select("id", F.col("far").alias("to")), "jumps")
        if found is None:
            found = jump.withColumnRenamed("to", "component")
        else:
            step = jump.select(F.col("id").alias("component"), "to")
            found = staged(found.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")
        tail, head = jump.select(F.col("id").alias("a"), F.col("to").alias("x")), jump.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = left.join(tail, "a").join(head, "b").where("x <> y")
        left = staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if found is None:
        return edges.sparkSession.createDataFrame([], "id bigint, component bigint")
    return found
