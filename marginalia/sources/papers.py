"""Paper rows to labelled text records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a title that become "_" in a record key.
CANDIDATE_KEY_CHARS = '/:*?"'
OWN_KEY_CHARS = "/:"


def paper_key(paper_id: Column, title: Column, chars: str = CANDIDATE_KEY_CHARS) -> Column:
    """`{id}_{title}.txt` with `chars` of the title replaced by `_`."""
    return F.concat(paper_id, F.lit("_"), F.translate(title, chars, "_" * len(chars)), F.lit(".txt"))


def own_paper_id(entry_id: Column) -> Column:
    """Last `/`-segment of a feed entry id."""
    return F.substring_index(entry_id, "/", -1)


def _text(value: Column) -> Column:
    """A missing field is an empty one, so that it does not take the whole record with it."""
    return F.coalesce(value, F.lit(""))


def _header() -> list[Column]:
    return [F.lit("Title: "), _text(F.col("title")), F.lit("\nAuthors: "), _text(F.array_join("authors", ", "))]


def render_records(papers: DataFrame, raw_date: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(key, title, authors, abstract, url, published) to the labelled block (key, content).

    `raw_date` keeps `published` as it is spelled, as is done for the reader's own papers. `keep`
    names further columns that pass through.
    """
    date = F.col("published").cast("string") if raw_date else F.date_format("published", "yyyy-MM-dd")
    content = F.concat(
        *_header(),
        F.lit("\nAbstract:\n"), _text(F.col("abstract")),
        F.lit("\nURL: "), _text(F.col("url")),
        F.lit("\nDate: "), _text(date), F.lit("\n"),
    )
    return papers.select("key", *keep, content.alias("content"))


def render_headers(papers: DataFrame) -> DataFrame:
    """(key, content) with the title and authors lines only, so that no abstract has to be read.

    The first `Authors:` of a record is always in these lines.
    """
    return papers.select("key", F.concat(*_header(), F.lit("\n")).alias("content"))


def author_papers(papers: DataFrame, author_id, column: str = "author_id") -> DataFrame:
    """All papers of one author (a value), or of several (a one-column DataFrame)."""
    if isinstance(author_id, DataFrame):
        ids = author_id.toDF(column)
        return papers.join(ids, column, "left_semi")
    return papers.where(F.col(column) == F.lit(author_id))
