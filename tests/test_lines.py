"""Entries found line by line against those of whole reports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import cards, lines

PIECES = [
    "## Priority (whitelist authors)", "## Other recommendations", "## Top Recommendations:", "### [a](u)", "### ", "  ### [b](v)", "###", "---",
    " \t--- ", "- ---", "", "  ", "text", "x ### y", "\x0b### [c](w)", "a\x0c---\x0cb", "mid ## Other recommendations ### [d](x)", "　text  ### e",
    "see ## Priority (whitelist authors) here",
]


def _reports():
    rng = random.Random(8)
    for n in range(60):
        body = [rng.choice(PIECES) for _ in range(rng.randrange(0, 14))]
        if n % 2:
            body = [PIECES[0], "", *body, PIECES[1], "", "  ### [late](z)", *[rng.choice(PIECES) for _ in range(rng.randrange(0, 9))]]
        yield f"d{n:02}", "\n".join(body)
    yield "d98", "".join(f"### [t{i}](u{i})\n**Authors:** a\n\n---\n\n" for i in range(40))
    yield "d99", ""


@pytest.mark.parametrize("run", [3, 4096])
def test_line_entries_equal_those_of_whole_reports(spark, run):
    reports = spark.createDataFrame(list(_reports()), "run_date string, md string").repartition(4)
    whole = cards.split_entries(cards.section_rows(cards.split_sections(reports), ["run_date"]), ["run_date", "section"])
    by_line = reports.select("run_date", F.posexplode(F.split("md", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
    found = lines.split_line_entries(by_line.repartition(5), run=run)
    columns = ["run_date", "section", "pos", "entry"]
    want = sorted(map(tuple, whole.select(*columns).collect()))
    assert sorted(map(tuple, found.select(*columns).collect())) == want and len(want) > 150


def test_running_count(spark):
    rows = spark.createDataFrame([(k, i, i % 3 == 0) for k in "ab" for i in range(50)], "k string, i bigint, f boolean").repartition(7)
    got = {(r.k, r.i): r.c for r in lines.running_count(rows, F.col("f"), ["k"], ["i"], "c", 4).collect()}
    assert got == {(k, i): i // 3 + 1 for k in "ab" for i in range(50)}


def test_lines_are_made_once(spark, tmp_path):
    """What the lines come from is gone over once, however often the lines are needed."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("d", k, line) for k, line in enumerate(["## Other recommendations", "### [a](u)", "x", "---", "### [b](u)"])]
    by_line = spark.createDataFrame(rows, "run_date string, line_no bigint, line string").mapInArrow(counted, "run_date string, line_no bigint, line string")
    assert [r.entry for r in lines.split_line_entries(by_line).orderBy("pos").collect()] == ["### [a](u)\nx", "### [b](u)"]
    assert made.value == 5
