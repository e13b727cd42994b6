from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import strings as S
from marginalia.operators import text
from marginalia.sources.papers import OWN_KEY_CHARS, own_paper_id, paper_key, render_records

RECORD = "Title: T1 \nAuthors: A One, B Two\nAbstract:\nL1\nL2\nURL: http://u/1\nDate: 2024-01-01"


def one(spark, value, expression):
    row = spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()
    return row.r


@pytest.mark.parametrize(
    ("content", "label", "wanted"),
    [
        ("Authors: Zed", "Title:", ""),
        ("Title: T1 \nX", "Title:", "T1"),
        ("x\nDate: 2024-01-01", "Date:", "2024-01-01"),
        ("Subtitle: Title: deep\n", "Title:", "deep"),
        ("Title:", "Title:", ""),
        ("Title:  wide 　\n", "Title:", "wide"),
    ],
)
def test_line_field(spark, content, label, wanted):
    assert one(spark, content, lambda c: S.line_field(c, label)) == wanted


@pytest.mark.parametrize(
    ("end", "wanted"), [("URL:", "L1\nL2"), ("Date:", "L1\nL2\nURL: http://u/1"), ("none", "L1\nL2\nURL: http://u/1\nDate: 2024-01-01")]
)
def test_block_field(spark, end, wanted):
    assert one(spark, RECORD, lambda c: S.block_field(c, "Abstract:", end)) == wanted
    assert one(spark, "no such block", lambda c: S.block_field(c, "Abstract:", end)) == ""


@pytest.mark.parametrize(
    ("content", "line", "block"),
    [
        ("", "", ""),
        ("no label", "", ""),
        ("T:", "", ""),
        ("T: a\tb \nD", "a\tb", "a\tb"),
        ("xT:\n y \n\x0b D z", "", "y"),
        ("T: one T: two\nT: three D", "one T: two", "one T: two\nT: three"),
        ("D T: after", "after", "after"),
        ("T:\x1c é \x0b", "é", "é"),
    ],
)
def test_fields_on_odd_whitespace(spark, content, line, block):
    assert one(spark, content, lambda c: S.line_field(c, "T:")) == line
    assert one(spark, content, lambda c: S.block_field(c, "T:", "D")) == block


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aT: \n\t  \x1c\x0béURLDate", max_size=40), min_size=30, max_size=60))
def test_strings_equal_python(spark, contents):
    """Strip, word split and line split agree with Python on odd whitespace."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, v string").select(
        "i",
        S.strip(F.col("v")).alias("strip"),
        S.words(F.col("v")).alias("words"),
        S.newline_only(F.col("v")).alias("lines"),
    )
    for row in rows.collect():
        content = contents[row.i]
        assert row.strip == content.strip()
        assert row.words == content.split()
        assert "\n".join(row.lines.split("\n")) == "\n".join((content + "|").splitlines())[:-1]


@pytest.mark.parametrize(
    "spelled", ["0.5", " 1 ", "1e3", "+.5", "5.", "1_0.2_5", "nan", "-inf", "Infinity", "1.0d", "1f", "0x1p3", "bad", "", "_1", "1__0"]
)
def test_python_float(spark, spelled):
    try:
        wanted = float(spelled)
    except ValueError:
        wanted = None
    got = one(spark, spelled, S.python_float)
    assert got == wanted or (got != got and wanted != wanted)


def test_parse_and_compose(spark):
    corpus = spark.createDataFrame([("k", RECORD)], "key string, content string")
    assert text.parse_records(corpus).first() == ("k", "T1", "A One, B Two", "L1\nL2", "http://u/1", "2024-01-01")
    assert text.compose_text(corpus).first() == ("k", "T1 [SEP] L1\nL2\nURL: http://u/1")
    assert text.compose_text(corpus, "URL:").first().text == "T1 [SEP] L1\nL2"


def test_substitute_separator(spark):
    texts = spark.createDataFrame([("k", "a [SEP] b[SEP]c")], "key string, text string")
    assert text.substitute_separator(texts, "</s>").first().text == "a </s> b</s>c"


def test_tokenize_stopwords(spark):
    texts = spark.createDataFrame([("k", "The cat's naïve Cat, the 2nd!")], "key string, text string")
    assert text.tokenize_stopwords(texts, ["THE"]).first().tokens == ["cat", "s", "naïve", "cat", "nd"]
    assert text.tokenize_stopwords(texts, []).first().tokens[0] == "the"


def test_paper_key(spark):
    row = (
        spark.createDataFrame([("http://h/abs/2401.1v1", 'A/B: C*?"D')], "entry string, title string")
        .select(
            paper_key(own_paper_id(F.col("entry")), F.col("title")).alias("candidate"),
            paper_key(own_paper_id(F.col("entry")), F.col("title"), OWN_KEY_CHARS).alias("own"),
        )
        .first()
    )
    assert row == ("2401.1v1_A_B_ C___D.txt", '2401.1v1_A_B_ C*?"D.txt')


def test_records_round_trip(spark):
    papers = spark.sql(
        "SELECT 'k' key, 'T' title, array('A B', 'C D') authors, 'one\ntwo' abstract, 'u' url, timestamp'2024-02-03 23:59:00' published"
    )
    content = render_records(papers)
    assert content.first().content == "Title: T\nAuthors: A B, C D\nAbstract:\none\ntwo\nURL: u\nDate: 2024-02-03\n"
    assert text.parse_records(content).first() == ("k", "T", "A B, C D", "one\ntwo", "u", "2024-02-03")
    raw = papers.withColumn("published", F.lit("Sat, 3 Feb 2024"))
    assert render_records(raw, raw_date=True).first().content.endswith("Date: Sat, 3 Feb 2024\n")
