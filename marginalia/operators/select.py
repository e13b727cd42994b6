"""Filters, windows and top-N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Slices in which a section is ranked before its best rows meet.
SPREAD = 64


def category_filter(papers: DataFrame, categories: Sequence[str], column: str = "categories") -> DataFrame:
    """Papers with any of `categories`; the column may be an array or a single string."""
    if not categories:
        return papers
    if papers.schema[column].dataType.typeName() == "array":
        return papers.where(F.arrays_overlap(column, F.array(*[F.lit(c) for c in categories])))
    return papers.where(F.col(column).isin(*categories))


def latest_timestamp(papers: DataFrame, column: str = "published") -> DataFrame:
    """One row: the newest `column`, or the current time when there is none."""
    now = F.current_timestamp().cast(papers.schema[column].dataType)
    return papers.agg(F.coalesce(F.max(column), now).alias("latest"))


def recent_window(
    papers: DataFrame,
    categories: Sequence[str] = (),
    days: int = 1,
    cap: int | None = None,
    published: str = "published",
    categories_column: str = "categories",
    tie: str = "key",
) -> DataFrame:
    """Papers of the last `days` x 24 h before the newest one, both ends included.

    The whole window, unsorted; with a `cap` only its newest rows, at most as many distinct
    (`published`, `tie`). The lower bound is a scalar subquery, so it reaches the scan as a pushed
    filter; the upper bound is the maximum itself and needs no test. A cap is found on these two
    narrow columns alone and its at most `cap` pairs are broadcast, so that the texts stay where they
    are read.
    """
    matching = category_filter(papers, categories, categories_column)
    start = latest_timestamp(matching, published).select(
        (F.col("latest") - F.make_dt_interval(F.lit(days))).alias("start")
    )
    recent = matching.where(F.col(published) >= start.scalar())
    if cap is None:
        return recent
    newest = recent.select(published, tie).distinct().orderBy(F.desc(published), tie).limit(cap)
    return recent.join(F.broadcast(newest), [published, tie], "left_semi")


def score_threshold(scores: DataFrame, threshold: float = 0.0, score: str = "score") -> DataFrame:
    """Rows with `score >= threshold`. Spark orders NaN above every number, so it is excluded."""
    return scores.where((F.col(score) >= F.lit(threshold)) & ~F.isnan(score))


def top_n(scores: DataFrame, n: int = 10, score: str = "score", tie: str = "key") -> DataFrame:
    """The `n` best rows; equal scores are ordered by `tie`."""
    return scores.orderBy(F.desc(score), F.asc(tie)).limit(n)


def top_n_per_section(
    scores: DataFrame,
    n: int = 10,
    by: Sequence[str] = ("section",),
    score: str = "score",
    tie: str = "key",
) -> DataFrame:
    """The `n` best rows of each section with their `rank`.

    There are few sections and one may hold most rows. So a section is cut to its best rows in SPREAD
    slices first, which is exact because a row of the top n is in its slice's top n; what meets in
    one task is at most SPREAD x n rows of a section.
    """
    order = [F.desc(score), F.asc(tie)]
    slices = Window.partitionBy(*by, "_slice").orderBy(*order)
    scores = (
        scores.withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(SPREAD)))
        .withColumn("_place", F.row_number().over(slices))
        .where(F.col("_place") <= n)
        .drop("_slice", "_place")
    )
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def retain_last_n(reports: DataFrame, n: int = 7, run_date: str = "run_date") -> DataFrame:
    """Reports of the `n` most recent run dates.

    The dates are found by a distinct and a top-n, so no window runs over all reports at once.
    """
    kept = reports.select(run_date).distinct().orderBy(F.desc(run_date)).limit(n)
    return reports.join(kept, run_date, "left_semi")


