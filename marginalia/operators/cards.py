"""From Markdown reports back to structured cards.

A report is one value of a row, so that reading it back is row-local: built-in string and array
functions, no window over lines and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import strings as S
from marginalia.operators.authors import OTHER, PRIORITY
from marginalia.operators.report import SECTION_HEADERS

RECORD_MARK = "\x1e"  # cannot occur in a text whose line boundaries are all "\n"
BLANKS = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"  # whitespace that ends no line
RULE_LINE = rf"(?m)^{BLANKS}---{BLANKS}$"

# Patterns and replacements for backticks in an abstract.
QUOTING_RULES = (
    (r"```[\s\S]*?```", ""),  # fenced code
    (r"`([^'\n]+)'", "'$1'"),  # `word'
    ("``", '"'),
    (r"`([^`]+)`", "$1"),  # inline code
    ("`", "'"),
)

# Where a url names a paper.
PAPER_ID_PATTERNS = (r"/pdf/([^/]+)\.pdf", r"/abs/([^/?#]+)", r"/html/([^/?#]+)")

# Colours of the score bands.
BAND_COLORS = {"green": "#22c55e", "amber": "#f59e0b", "red": "#ef4444"}
GREEN_MARGIN = 0.1


def lines_of(text: Column) -> Column:
    return F.split(S.newline_only(text), "\n")


def split_sections(reports: DataFrame) -> DataFrame:
    """Add `priority` and `other`. Unless both headers occur, everything is `other`."""
    priority_header, other_header = SECTION_HEADERS[PRIORITY], SECTION_HEADERS[OTHER]
    md = F.col("md")
    at_priority = F.instr(md, F.lit(priority_header))
    at_other = F.instr(md, F.lit(other_header))
    both = (at_priority > 0) & (at_other > 0)
    begin = at_priority + F.lit(len(priority_header))
    between = F.substr(md, begin, F.greatest(at_other - begin, F.lit(0)))
    return reports.withColumns(
        {
            "priority": F.when(both, S.strip(between)).otherwise(F.lit("")),
            "other": F.when(both, S.strip(S.after(md, other_header))).otherwise(md),
        }
    )


def section_rows(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by` columns with one row per section: (section, text)."""
    rows = F.array(
        F.struct(F.lit(PRIORITY).alias("section"), F.col("priority").alias("text")),
        F.struct(F.lit(OTHER).alias("section"), F.col("other").alias("text")),
    )
    return sections.select(*by, F.inline(rows))


def entry_count(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda line: F.startswith(S.strip(line), F.lit("### "))))


def count_entries(sections: DataFrame) -> DataFrame:
    """Add `priority_n` and `other_n`, the numbers of level-3 headings."""
    return sections.withColumns(
        {"priority_n": entry_count(F.col("priority")), "other_n": entry_count(F.col("other"))}
    )


def split_entries(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by` columns and `text` to (by, pos, entry).

    A line starting with `### ` opens an entry and a `---` line closes one. Text before the first
    opening is ignored; text after a closing is an entry of its own; blank entries are dropped.
    """
    text = F.concat(F.lit("\n"), S.newline_only(F.col("text")))
    opening = F.instr(text, F.lit("\n### "))
    body = F.when(opening > 0, F.substr(text, opening)).otherwise(F.lit(""))
    marked = F.replace(
        F.regexp_replace(body, RULE_LINE, RECORD_MARK), F.lit("\n### "), F.lit(f"\n{RECORD_MARK}### ")
    )
    entries = F.filter(F.transform(F.split(marked, RECORD_MARK), S.strip), lambda e: e != "")
    return sections.select(*by, F.posexplode(entries).alias("pos", "entry"))


def _link_title(line: Column) -> Column:
    return S.before(S.after(line, "["), "]")


def _link_url(line: Column) -> Column:
    rest = S.after(line, "](")
    up_to_last = F.regexp_extract(rest, r"(?s)^(.*)\)", 1)
    return F.when(F.contains(rest, F.lit(")")), up_to_last).otherwise(rest)


def _is_link(line: Column) -> Column:
    return F.startswith(line, F.lit("### [")) & F.contains(line, F.lit("]("))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Replace `entry` by title, url, authors, date, score (NULL if not a number), abstract.

    Of a repeated field the last one before the abstract counts; every line after the abstract's
    own line belongs to it, and text on that line is lost.
    """
    kept = [c for c in entries.columns if c != "entry"]
    starts = F.transform("_lines", lambda line: F.startswith(S.strip(line), F.lit("**Abstract:**")))
    split = entries.withColumn("_lines", lines_of(F.col("entry"))).withColumn("_at", F.array_position(starts, True))
    at = F.col("_at").cast("int")
    head = F.when(at > 0, F.slice("_lines", F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(F.col("_lines"))
    split = split.withColumn("_head", F.transform(head, S.strip))

    def field(label: str) -> Column:
        last = F.try_element_at(F.filter("_head", lambda line: F.startswith(line, F.lit(label))), F.lit(-1))
        return S.strip(F.replace(last, F.lit(label), F.lit("")))

    opened = F.startswith(F.element_at("_lines", 1), F.lit("### "))
    first = S.strip(F.element_at("_lines", 1))
    linked = opened & _is_link(first)
    rest = F.slice("_lines", at + F.lit(1), F.greatest(F.size("_lines") - at, F.lit(0)))
    return split.select(
        *kept,
        F.when(linked, _link_title(first)).otherwise(F.lit("")).alias("title"),
        F.when(linked, _link_url(first)).otherwise(F.lit("")).alias("url"),
        F.coalesce(field("**Authors:**"), F.lit("")).alias("authors"),
        F.coalesce(field("**Date:**"), F.lit("")).alias("date"),
        S.python_float(field("**Similarity Score:**")).alias("score"),
        F.when(at > 0, S.strip(F.array_join(rest, "\n"))).otherwise(F.lit("")).alias("abstract"),
    )


def entry_links(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by` columns and `text` to (by, pos, title, url), one row per heading that is a link."""
    lines = F.transform(lines_of(F.col("text")), S.strip)
    links = F.filter(lines, lambda line: _is_link(line) & F.endswith(line, F.lit(")")))
    exploded = sections.select(*by, F.posexplode(links).alias("pos", "line"))
    return exploded.select(
        *by, "pos", _link_title(F.col("line")).alias("title"), _link_url(F.col("line")).alias("url")
    )


def sanitize_abstract(cards: DataFrame, column: str = "abstract") -> DataFrame:
    """Remove code fences and turn backtick quoting into plain quotes, by QUOTING_RULES in order."""
    text = F.col(column)
    for pattern, replacement in QUOTING_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return cards.withColumn(column, text)


def score_bands(cards: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Add `band`, `color`, `percent` and `fill`; a NULL score counts as 0."""
    score = F.coalesce("score", F.lit(0.0))
    band = (
        F.when(score >= F.lit(threshold + GREEN_MARGIN), "green")
        .when(score >= F.lit(threshold), "amber")
        .otherwise("red")
    )
    color = F.create_map(*[F.lit(x) for item in BAND_COLORS.items() for x in item])
    percent = F.least(F.greatest(F.rint(score * 100), F.lit(0.0)), F.lit(100.0)).cast("int")
    return cards.withColumns(
        {"band": band, "color": color[band], "percent": percent, "fill": F.greatest(percent, F.lit(1))}
    )


def paper_links(cards: DataFrame, site: str) -> DataFrame:
    """Add `paper_id`, found in `url`, and the abstract and HTML page of that paper on `site`.

    All three are '' when the url names no paper.
    """
    found = [F.nullif(F.regexp_extract("url", p, 1), F.lit("")) for p in PAPER_ID_PATTERNS]
    with_id = cards.withColumn("paper_id", F.coalesce(*found, F.lit("")))

    def page(kind: str) -> Column:
        link = F.concat(F.lit(f"{site.rstrip('/')}/{kind}/"), "paper_id")
        return F.when(F.col("paper_id") != "", link).otherwise(F.lit(""))

    return with_id.withColumns({"abs_url": page("abs"), "html_url": page("html")})


def display_defaults(cards: DataFrame) -> DataFrame:
    """Fill in what a card shows for a missing title, url or score (as `score_label`)."""
    score = F.col("score")
    # Spark writes numbers below 0.001 with an exponent, Python only those below 0.0001.
    small = (F.abs(score) < 1e-3) & (F.abs(score) >= 1e-4)
    plain = F.regexp_replace(F.format_number(score, 20), "0+$", "")
    label = F.when(small, plain).otherwise(score.cast("string"))
    return cards.withColumns(
        {
            "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")),
            "url": F.coalesce(F.nullif("url", F.lit("")), F.lit("#")),
            "score_label": F.coalesce(label, F.lit("N/A")),
        }
    )


def date_label(run_date: Column) -> Column:
    """`2026-12-01` to `December 1, 2026`; anything else stays as it is."""
    day = F.try_to_timestamp(run_date, F.lit("yyyy-M-d"))
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), run_date)


def run_history(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """(run_date, md, modified) to (run_date, label, priority_n, other_n), newest file first.

    All reports in that order; `limit` shows the newest ones only. A report that cannot be read
    (NULL text) counts 0 and 0.
    """
    counted = count_entries(split_sections(reports.withColumn("md", F.coalesce("md", F.lit("")))))
    label = F.concat(
        date_label(F.col("run_date")),
        F.lit(" — Priority "), F.col("priority_n").cast("string"),
        F.lit(", Other "), F.col("other_n").cast("string"),
    )
    rows = counted.select("run_date", "modified", label.alias("label"), "priority_n", "other_n")
    rows = rows.orderBy(F.desc("modified"), F.desc("run_date"))
    return (rows if limit is None else rows.limit(limit)).drop("modified")


def export_links(links: DataFrame, selection: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos, url) and the selected (by, pos) to (by, links): urls in entry order, one a line.

    A group is what a reader ticked in one section of one report.
    """
    chosen = links.join(selection, [*by, "pos"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "url")))
    grouped = chosen.groupBy(*by).agg(ordered.alias("_urls"))
    return grouped.select(*by, F.array_join(F.transform("_urls", lambda u: u["url"]), "\n").alias("links"))
