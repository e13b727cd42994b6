"""Labelled text records to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import strings as S

SEPARATOR = "[SEP]"  # fixed value: mark between title and abstract in encoder input


def with_line_field(df: DataFrame, column: str, label: str, out: str) -> DataFrame:
    return df.withColumn(out, S.line_field(F.col(column), label))


def with_block_field(df: DataFrame, column: str, start: str, end: str, out: str) -> DataFrame:
    return df.withColumn(out, S.block_field(F.col(column), start, end))


def parse_records(corpus: DataFrame) -> DataFrame:
    """Put title, authors, abstract, url and date in place of `content`."""
    content = F.col("content")
    return corpus.select(
        *[c for c in corpus.columns if c != "content"],
        S.line_field(content, "Title:").alias("title"),
        S.line_field(content, "Authors:").alias("authors"),
        S.block_field(content, "Abstract:", "URL:").alias("abstract"),
        S.line_field(content, "URL:").alias("url"),
        S.line_field(content, "Date:").alias("date"),
    )


def compose_text(corpus: DataFrame, end_label: str = "Date:") -> DataFrame:
    """Put encoder input `text` = `{title} [SEP] {abstract}` in place of `content`.

    The abstract ends at `end_label`. With the default the `URL:` line belongs to it; pass
    `URL:` to leave it out.
    """
    content = F.col("content")
    text = F.concat(
        S.line_field(content, "Title:"),
        F.lit(f" {SEPARATOR} "),
        S.block_field(content, "Abstract:", end_label),
    )
    return corpus.withColumn("text", text).drop("content")


def substitute_separator(texts: DataFrame, separator: str) -> DataFrame:
    """Put the encoder's own separator for the spaced mark, then for any bare one."""
    spaced = F.replace("text", F.lit(f" {SEPARATOR} "), F.lit(f" {separator} "))
    return texts.withColumn("text", F.replace(spaced, F.lit(SEPARATOR), F.lit(separator)))


def tokenize_stopwords(texts: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """(key, text) to (key, tokens): lower-cased letter runs that are not stop words."""
    stop = F.array(*[F.lit(w) for w in sorted({w.lower() for w in stopwords})]).cast("array<string>")
    runs = F.split(F.lower("text"), r"[^\p{L}]+")
    kept = F.filter(runs, lambda w: (w != "") & ~F.array_contains(stop, w))
    return texts.select("key", kept.alias("tokens"))
