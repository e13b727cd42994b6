"""The daily recommendation as one Spark plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.authors import route_priority
from marginalia.operators.report import assemble_report, render_entries
from marginalia.operators.select import recent_window, score_threshold, top_n_per_section
from marginalia.operators.similarity import score_candidates
from marginalia.operators.text import compose_text, parse_records
from marginalia.options import RecommendOptions
from marginalia.session import staged
from marginalia.sources.papers import render_headers, render_records
from marginalia.sources.tables import latest_by_key

SECTIONS = 2
BROADCAST_ROWS = 100_000


def recommend(
    papers: DataFrame,
    my_vectors: DataFrame,
    black: DataFrame,
    white: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    options: RecommendOptions = RecommendOptions(),
) -> DataFrame:
    """(section, rank, key, score, title, authors, abstract, url, date) of the best new papers.

    Authors are filtered before anything is encoded. From scan to score a paper stays in one
    stage while the name lists and the own vectors are small; only the top rows of each partition
    are shuffled. The texts of the winners are then fetched by a second, broadcast-filtered scan of
    the same window and rendered after that join, so that no text is carried through the ranking.
    """
    recent = recent_window(papers, options.categories, options.days, options.cap)
    # Of several versions of a paper the latest counts, as in a table that is written by key.
    recent = latest_by_key(recent, "key", F.struct("published", "title", "abstract", "url"))
    routed = route_priority(render_records(recent), black, white, headers=render_headers(recent))
    best = _best(routed, my_vectors, encode, options)
    return _cards(render_records(recent.join(best, "key"), keep=("section", "rank", "score")))


def recommend_records(
    corpus: DataFrame,
    my_vectors: DataFrame,
    black: DataFrame,
    white: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    options: RecommendOptions = RecommendOptions(),
) -> DataFrame:
    """The same over labelled text records (key, content), such as a scanned directory of candidates.

    The directory is the window, so neither categories nor days are looked at; keys are file names. The records
    are opened once and written as one table, which the three passes over them read.
    """
    corpus = staged(corpus.select("key", "content"), "records")
    routed = route_priority(corpus, black, white)
    best = _best(routed, my_vectors, encode, options)
    return _cards(corpus.join(best, "key"))


def _best(routed: DataFrame, my_vectors: DataFrame, encode: Callable[[DataFrame], DataFrame], options: RecommendOptions) -> DataFrame:
    """(section, rank, key, score) of the top N of each section."""
    scored = score_candidates(encode(compose_text(routed)), my_vectors)
    best = top_n_per_section(score_threshold(scored, options.threshold), options.top_n)
    # Every key of `best` comes from the papers, and there are at most SECTIONS x top_n of them.
    return F.broadcast(best) if SECTIONS * options.top_n <= BROADCAST_ROWS else best


def _cards(won: DataFrame) -> DataFrame:
    return parse_records(won).select("section", "rank", "key", "score", "title", "authors", "abstract", "url", "date")


def daily_report(recs: DataFrame, run_date: Column) -> DataFrame:
    """(run_date, md) of one run: always one row, with an empty text if nothing is recommended.

    So a rerun without recommendations replaces an earlier report of its day.
    """
    made = assemble_report(render_entries(recs.withColumn("run_date", run_date)))
    # An aggregate without keys has one row whatever there is to aggregate.
    return made.agg(F.coalesce(F.max("md"), F.lit("")).alias("md")).select(run_date.alias("run_date"), "md")
