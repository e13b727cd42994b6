"""From ranked recommendations to dated Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.authors import OTHER, PRIORITY
from marginalia.operators.text import parse_records
from marginalia.session import staged

# Headers of a report.
SECTION_HEADERS = {PRIORITY: "## Priority (whitelist authors)", OTHER: "## Other recommendations"}
TOP_HEADER = "## Top Recommendations:"


def attach_records(recs: DataFrame, records: DataFrame, stage: bool = True) -> DataFrame:
    """Join (key, ...) with the parsed record (key, content); a missing record is an error.

    The records are cut down to the wanted keys before they are parsed and joined. With `stage`
    the recommendations are written first, so that Spark knows how few they are and broadcasts
    them to the records instead of shuffling all texts.
    """
    if stage:
        recs = staged(recs, "recs")
    wanted = records.join(recs.select("key"), "key", "left_semi")
    parsed = parse_records(wanted).withColumn("_found", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no record for key "), F.col("key").cast("string")))
    found = F.when(F.col("_found"), F.col("_found")).otherwise(missing.cast("boolean"))
    return recs.join(parsed, "key", "left").where(found).drop("_found")


def score_text(score: Column) -> Column:
    """Four decimals, rounded on the exact binary value as Python's `%.4f` does."""
    return F.format_number(score, 4)


def render_entries(recs: DataFrame) -> DataFrame:
    """Add `entry`, the Markdown of one recommendation."""
    entry = F.concat(
        F.lit("### ["), "title", F.lit("]("), "url", F.lit(")\n**Authors:** "), "authors",
        F.lit("\n**Date:** "), "date",
        F.lit("\n**Similarity Score:** "), score_text(F.col("score")),
        F.lit("\n**Abstract:**\n"), "abstract", F.lit("\n\n---\n\n"),
    )
    return recs.withColumn("entry", entry)


def assemble_report(entries: DataFrame) -> DataFrame:
    """(run_date, section, rank, entry) to (run_date, md), one Markdown text per run date.

    Priority comes before Other and a section without entries is left out.
    """
    item = F.struct("rank", "entry")
    grouped = entries.groupBy("run_date").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("section") == name, item))).alias(name)
            for name in SECTION_HEADERS
        ]
    )

    def section(name: str) -> Column:
        body = F.array_join(F.transform(F.col(name), lambda e: e["entry"]), "")
        text = F.concat(F.lit(f"{SECTION_HEADERS[name]}\n\n{TOP_HEADER}\n\n"), body, F.lit("\n"))
        return F.when(F.size(name) > 0, text).otherwise(F.lit(""))

    return grouped.select("run_date", F.concat(*[section(name) for name in SECTION_HEADERS]).alias("md"))


def ordered_chunks(entries: DataFrame) -> DataFrame:
    """(run_date, section, rank, entry) to (run_date, section_no, rank, chunk): the same text, an entry a row.

    The chunks of a day, in order, are what `assemble_report` makes of it: the first entry of a section carries the
    headers and the last one the closing line break. Where a section begins and ends is a small aggregate, so
    no day is ever one value or one task.
    """
    names = list(SECTION_HEADERS)
    known = entries.where(F.col("section").isin(names))
    ends = staged(known.groupBy("run_date", "section").agg(F.min("rank").alias("_first"), F.max("rank").alias("_last")), "section-ends")
    header = F.lit("")
    number = F.lit(None).cast("int")
    for at, name in enumerate(names):
        header = F.when(F.col("section") == name, F.lit(f"{SECTION_HEADERS[name]}\n\n{TOP_HEADER}\n\n")).otherwise(header)
        number = F.when(F.col("section") == name, F.lit(at)).otherwise(number)
    opening = F.when(F.col("rank") == F.col("_first"), header).otherwise(F.lit(""))
    closing = F.when(F.col("rank") == F.col("_last"), F.lit("\n")).otherwise(F.lit(""))
    chunk = F.concat(opening, F.col("entry"), closing)
    return known.join(ends, ["run_date", "section"]).select("run_date", number.alias("section_no"), "rank", chunk.alias("chunk"))
