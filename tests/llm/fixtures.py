"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside themselves.
CLASHES = "label int, size long, words string, score_ double, draw string, k string, rep long, bucket long, target double, part int, "
CLASHES += "score double, row long, slice string, whole long, extra long, taken long, cut string, digest string, mark string, _x_row long, _x_k string, "
CLASHES += "_draw string, _k string, _cut long, _size long, _target double, _last string, _times int, rank int, weight double"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ne", "ti", "or", "éa")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows=None, extra: bool = False):
    """Rows (doc_id, text, lang, source); nulls, empty, blank and very long texts, copies and ties."""
    base = prose(1, 60)
    given = rows if rows is not None else [
        (1, base, "aa", "s1"),
        (2, base, "aa", "s1"),
        (3, base.replace("ba", "zu", 1), "aa", "s2"),
        (4, None, None, None),
        (5, "", "aa", "s2"),
        (6, " \t\n ", "aa", None),
        (7, prose(2, 40_000), "bb", "s3"),
        (8, "one two", "bb", "s1"),
        (9, "one two", "bb", "s3"),
        (None, "a row without an id", "bb", "s1"),
        (10, prose(3, 30), "bb", "s1"),
        (10, prose(3, 30), "bb", "s1"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in given], DOCS)
    if extra:
        for column in CLASHES.split(", "):
            name, kind = column.split(" ")
            frame = frame.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return frame


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
