"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most `max_epochs` times. Words are shared by weight;
sources that would exceed their cap are clamped to it and what they cannot take is shared among the
others again, until none is above. A source's target is then met by whole repetitions of all its
documents and one seeded fractional repetition, which ends inside the document where the target is
reached. All of it is DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, fresh_prefix
from marginalia.session import staged


@dataclass(frozen=True)
class MixOptions:
    share: float = 1.5  # words of the mix, as a share of all words
    max_epochs: float = 2.0
    weights: tuple[int, ...] = (5, 2, 1)  # repeated over the sources in code-point order, null last
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key that tells a null source from every text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _draw(seed: str) -> Column:
    """The seeded place of a document in its source's order; it depends on the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources in order from 0 without bringing them into one task.

    A sort deals ranges to tasks; only the number of rows of each range meets in one place.
    """
    ordered = staged(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources"
    )
    parted = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = parted.groupBy("part").count()
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return parted.join(F.broadcast(offsets), "part").select("source", "source_size", (F.col("offset") + F.col("place")).alias("rank"))


def targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(source, source_size, weight, target) of each source of (source, size).

    Each round of the water-filling is one aggregate over the sources: with the level of the round,
    those at or above their cap are clamped, and the rest of the words is shared by the rest of the
    weights. The level only rises, and the loop ends when no further source is clamped.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = F.array(*[F.lit(w) for w in options.weights])
    weight = F.element_at(names, (F.col("rank") % len(options.weights) + 1).cast("int")).cast("double")
    table = staged(
        _ranked(per_source).select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(options.max_epochs)).alias("cap")
        ),
        "mix-weights",
    )
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * options.share
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        row = table.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("left")
        ).first()
        if row.n == clamped or row.left is None:
            break
        clamped, level = row.n, (total - (row.taken or 0.0)) / row.left
    else_level = F.lit(float("inf")) if row.left is None else F.lit(level)
    return table.select("source", "source_size", "weight", F.least("cap", F.col("weight") * else_level).alias("target"))


def _plan(docs: DataFrame, options: MixOptions, row: Column) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of the documents, and for each (source, slice of the order) where its words begin.

    `row` numbers the rows, so that rows of one id (or of none) have places of their own.

    A source of any size is cut into 4096 slices of its seeded order. Their sums are combined before
    the shuffle; a window then runs over the slices of a source, never over its documents.
    """
    rows = staged(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(options.seed).alias("draw"), row.alias("row")), "mix-sizes"
    ).select("*", _key(F.col("source")).alias("k"), F.substring("draw", 1, 3).alias("slice"))
    goals = targets(rows, options).select(
        _key(F.col("source")).alias("k"), "source_size", "weight", "target", F.floor(F.col("target") + 0.5).alias("goal")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("extra", F.col("goal") - F.col("whole") * F.col("source_size"))
    sums = rows.groupBy("k", "slice").agg(F.sum("size").alias("words"))
    before = W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    begins = sums.select("k", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"))
    return rows, begins.join(goals, "k")


def _placed(docs: DataFrame, options: MixOptions, row: Column) -> DataFrame:
    """Every row's place in its source's order (draw, doc_id, row) and the words that are taken of it."""
    rows, begins = _plan(docs, options, row)
    order = W.partitionBy("k", "slice").orderBy("draw", "doc_id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.join(begins, ["k", "slice"]).withColumn("end", F.col("begin") + F.sum("size").over(order))
    extra = F.least("size", F.greatest(F.lit(0), F.col("extra") - (F.col("end") - F.col("size"))))
    return placed.withColumn("taken", F.col("whole") * F.col("size") + extra)


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, taken): how many words the mix takes of each row.

    A null text has size 0; a null source is a source of its own, ranked last; rows that repeat count
    each, and have places of their own. The words taken of a source add up to its target, rounded. An empty
    table gives none. A text of any length is counted whole, within its row; other columns are not read.
    """
    placed = _placed(docs, options, F.monotonically_increasing_id())
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target", "taken")


def mix_rows(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The mix itself, in the columns of `docs`: each row as often as it is taken.

    The rows are written with a number first, which tells rows that repeat apart. The fractional repetition of
    a source is known by one border in its seeded order, so texts are joined with one row per source
    (broadcast by Spark only where that table is small, else split by adaptive execution) and are never
    shuffled by document. The document at the border is cut after the words that remain, white space between
    its words becoming single spaces, and `n_chars` follows. So the words of the rows are those of `mix`, also
    where ids repeat or are null. Own columns get names that `docs` does not have.
    """
    p = fresh_prefix(docs.columns)
    numbered = staged(docs.withColumn(f"{p}row", F.monotonically_increasing_id()), "mix-rows")
    taken = _placed(numbered, options, F.col(f"{p}row"))
    at = F.struct("draw", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "row")
    divisor = F.greatest("size", F.lit(1))
    part = F.col("taken") - F.col("whole") * F.col("size")
    border = staged(
        taken.groupBy(F.col("k").alias(f"{p}k")).agg(
            F.max("whole").alias(f"{p}whole"),
            # The last row that is taken once more than the others, and the one that is cut.
            F.max(F.when((F.col("size") > 0) & (part == F.col("size")), at)).alias(f"{p}last"),
            F.max(F.when((part > 0) & (part < divisor), F.struct(at.alias("at"), part.alias("words")))).alias(f"{p}cut"),
        ),
        "mix-borders",
    )
    here = F.struct(_draw(options.seed).alias("draw"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col(f"{p}row").alias("row"))
    joined = numbered.withColumn(f"{p}k", _key(F.col("source"))).join(border, f"{p}k").withColumn(f"{p}here", here)
    at_cut = F.coalesce(F.col(f"{p}here") == F.col(f"{p}cut.at"), F.lit(False))
    above = F.coalesce(F.col(f"{p}here") <= F.col(f"{p}last"), F.lit(False))
    copies = (
        joined.withColumn(f"{p}short", at_cut)
        .withColumn(f"{p}times", F.col(f"{p}whole").cast("int") + (above | at_cut).cast("int"))
        .where(F.col(f"{p}times") > 0)
        .withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}times"))))
        .withColumn(f"{p}short", F.col(f"{p}short") & (F.col(f"{p}copy") == F.col(f"{p}times")))
    )
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(f"{p}cut.words").cast("int"))
    short = F.col(f"{p}short")
    cut = {"text": F.when(short, F.array_join(words, " ")).otherwise(F.col("text"))}
    out = copies.withColumns(cut)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(short, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
