"""Entries of reports that are read line by line, for days that are larger than a row should be.

The rules are those of `split_sections` and `split_entries`, whose entries these are. What depends on all earlier
lines is a running count. It is carried over runs of lines of fixed length: each run is counted by itself, the
counts of a day's runs are added up, and only then are a run's own lines counted one by one. So no task
sees more than a run of a day's lines, or one entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import strings as S
from marginalia.operators.authors import OTHER, PRIORITY
from marginalia.operators.cards import BLANKS
from marginalia.operators.report import SECTION_HEADERS
from marginalia.session import staged

#: Lines, or entries, of a run.
RUN = 4096
RULE = rf"^{BLANKS}---{BLANKS}$"


def running_count(rows: DataFrame, flag: Column, by: Sequence[str], order: Sequence[str], out: str, run: int = RUN) -> DataFrame:
    """Add `out`, how many rows of the same `by` up to this one, by `order`, have `flag`.

    The first column of `order` is a number from 0 on, of which a run takes `run` consecutive values.
    """
    rows = rows.withColumn("_flag", flag.cast("bigint")).withColumn("_run", F.floor(F.col(order[0]) / run))
    sums = rows.groupBy(*by, "_run").agg(F.sum("_flag").alias("_marks"))
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = staged(sums.select(*by, "_run", F.coalesce(F.sum("_marks").over(earlier), F.lit(0)).alias("_carried")), "carried-counts")
    within = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.join(carried, [*by, "_run"]).withColumn(out, F.col("_carried") + F.sum("_flag").over(within))
    return counted.drop("_flag", "_run", "_carried")


def section_lines(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, line_no, line) to (by, section, line_no, sub, line): the lines of each section, stripped as a whole.

    The headers may stand anywhere in a line; unless both occur, everything is Other. A line that other
    breaks than a line feed divide is several, counted by `sub`.
    """
    texts = {PRIORITY: SECTION_HEADERS[PRIORITY], OTHER: SECTION_HEADERS[OTHER]}
    where = {name: F.instr("line", F.lit(text)) for name, text in texts.items()}
    heads = lines.groupBy(*by).agg(*[
        F.min(F.when(at > 0, F.struct("line_no", at.alias("at")))).alias(f"_{name}") for name, at in where.items()
    ])
    heads = staged(heads, "section-heads")
    both = F.col(f"_{PRIORITY}").isNotNull() & F.col(f"_{OTHER}").isNotNull()
    rows = lines.join(heads, list(by))

    def begin(name: str) -> Column:
        """Where the text of the section begins in this line; 0 where it has not begun."""
        head = F.col(f"_{name}")
        here = head["at"] + len(texts[name])
        return F.when(F.col("line_no") == head["line_no"], here).when(F.col("line_no") > head["line_no"], F.lit(1)).otherwise(F.lit(0))

    other = F.col(f"_{OTHER}")
    end = F.when(F.col("line_no") == other["line_no"], other["at"]).when(F.col("line_no") < other["line_no"], F.length("line") + 1).otherwise(F.lit(0))

    def part(name: str, start: Column, stop: Column, there: Column) -> Column:
        text = F.substr("line", start, F.greatest(stop - start, F.lit(0)))
        return F.struct(F.lit(name).alias("section"), F.when(there, text).alias("line"))

    first = begin(PRIORITY)
    parts = F.when(both, F.array(
        part(PRIORITY, F.greatest(first, F.lit(1)), end, (first > 0) & (end >= first)),
        part(OTHER, F.greatest(begin(OTHER), F.lit(1)), F.length("line") + 1, begin(OTHER) > 0),
    )).otherwise(F.array(F.struct(F.lit(OTHER).alias("section"), F.col("line").alias("line"))))
    found = rows.select(*by, both.alias("_both"), "line_no", F.inline(parts)).where(F.col("line").isNotNull())
    found = found.select(*by, "_both", "section", "line_no", F.posexplode(F.split(S.newline_only(F.col("line")), "\n")).alias("sub", "line"))
    # A section is stripped, so its first and last lines with something in them lose the blanks around that.
    place = F.struct("line_no", "sub")
    filled = found.where("_both").where(S.strip(F.col("line")) != "").groupBy(*by, "section").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    found = found.join(staged(filled, "first-lines"), [*by, "section"], "left")
    line = F.when(place == F.col("_first"), F.ltrim(F.col("line"), F.lit(S.WHITESPACE))).otherwise(F.col("line"))
    line = F.when(place == F.col("_last"), F.rtrim(line, F.lit(S.WHITESPACE))).otherwise(line)
    return found.select(*by, "section", "line_no", "sub", line.alias("line"))


def split_line_entries(lines: DataFrame, by: Sequence[str] = ("run_date",), run: int = RUN) -> DataFrame:
    """(by, line_no, line) to (by, section, pos, entry), as `split_entries` gives them for whole reports."""
    keys = [*by, "section"]
    lines = staged(lines.select(*by, "line_no", "line"), "report-lines")  # read three times
    rows = staged(section_lines(lines, by), "section-lines")
    opens, rules = F.startswith("line", F.lit("### ")), F.regexp_like("line", F.lit(RULE))
    place = F.struct("line_no", "sub")
    starts = staged(rows.where(opens).groupBy(*keys).agg(F.min(place).alias("_start")), "section-starts")
    body = rows.join(starts, keys).where(place >= F.col("_start")).drop("_start")
    numbered = running_count(body, opens | rules, keys, ["line_no", "sub"], "_entry", run)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "sub", "line")))
    entries = numbered.where(~rules).groupBy(*keys, "_entry").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("entry"))
    entries = staged(entries.withColumn("entry", S.strip(F.col("entry"))).where("entry <> ''"), "line-entries")
    counted = running_count(entries.select(*keys, "_entry"), F.lit(True), keys, ["_entry"], "_pos", run)
    return entries.join(counted, [*keys, "_entry"]).select(*keys, (F.col("_pos") - 1).cast("int").alias("pos"), "entry")
