from __future__ import annotations

import itertools

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from marginalia.operators import authors
from marginalia.sources.papers import render_headers, render_records

#: Names, the first and last word expected of each, and the names of this table it matches strictly.
GOLDEN = {
    "Ann B. Clark": ("ann", "clark", {"Ann B. Clark", "A. Clark", "Ann Clark"}),
    "A. Clark": ("a", "clark", {"Ann B. Clark", "A. Clark", "Ann Clark", "Amy Clark"}),
    "Ann Clark": ("ann", "clark", {"Ann B. Clark", "A. Clark", "Ann Clark"}),
    "Amy Clark": ("amy", "clark", {"A. Clark", "Amy Clark"}),
    "Clark": ("clark", "", set()),
    "Clark, Ann": ("clark", "ann", {"Clark, Ann"}),
    "B. Clark": ("b", "clark", {"B. Clark"}),
    "Mary-Ann O'Neil": ("mary", "neil", {"Mary-Ann O'Neil", "M. Neil"}),
    "M. Neil": ("m", "neil", {"Mary-Ann O'Neil", "M. Neil"}),
    "Éva Émile": ("éva", "émile", {"Éva Émile", "é. émile"}),
    "é. émile": ("é", "émile", {"Éva Émile", "é. émile"}),
    "": ("", "", set()),
    " . ": ("", "", set()),
    "(Bo) Li": ("bo", "li", {"(Bo) Li", "B Li", "b_o Li"}),
    "B Li": ("b", "li", {"(Bo) Li", "B Li", "b_o Li"}),
    "b_o Li": ("b", "li", {"(Bo) Li", "B Li", "b_o Li"}),
    "X Y": ("x", "y", {"X Y"}),
    "Plato": ("plato", "", set()),
}
NAMES = list(GOLDEN)
#: The loose rule also brings these together.
ALSO_LOOSE = {"Ann B. Clark": {"Amy Clark"}, "Ann Clark": {"Amy Clark"}, "Amy Clark": {"Ann B. Clark", "Ann Clark"}}


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def _corpus(spark, lines):
    rows = [(i, f"Title: t\nAuthors: {line}\nAbstract:\nx\n") for i, line in enumerate(lines)]
    return spark.createDataFrame([*rows, (len(rows), "Title: no authors here\n")], "key int, content string")


def test_normalize_names(spark):
    rows = authors.normalize_names(_names(spark, NAMES), "name").collect()
    assert {r.name: (r["first"], r["last"]) for r in rows} == {n: (first, last) for n, (first, last, _) in GOLDEN.items()}


def test_explode_authors(spark):
    corpus = _corpus(spark, ["A One, , Authors: B Two ,"])
    assert [tuple(r) for r in authors.explode_authors(corpus).collect()] == [(0, 0, "A One"), (0, 1, "B Two")]
    unfinished = spark.createDataFrame([(1, "Authors: A One")], "key int, content string")
    assert authors.explode_authors(unfinished).first().author == "A One"


@pytest.mark.parametrize("mode", ["strict", "loose"])
@pytest.mark.parametrize("salts", [1, 3])
def test_author_match_equals_all_pairs(spark, mode, salts):
    candidates = spark.createDataFrame([(i, 0, n) for i, n in enumerate(NAMES)], "key int, pos int, author string")
    for chosen in (NAMES, NAMES[:1], NAMES[1:2], NAMES[9:11], []):
        got = [r.key for r in authors.author_match(candidates, _names(spark, chosen), mode, salts).collect()]
        met = {n: GOLDEN[n][2] | (ALSO_LOOSE.get(n, set()) if mode == "loose" else set()) for n in NAMES}
        wanted = [i for i, n in enumerate(NAMES) if met[n] & set(chosen)]
        assert sorted(got) == wanted


def test_author_match_rejects_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        authors.author_match(_corpus(spark, []), _names(spark, []), "fuzzy")


@pytest.mark.parametrize("how", [{}, {"inline": 0}, {"inline": 0, "stage": False}, {"inline": 2}])
def test_routing_equals_all_pairs(spark, how):
    pairs = list(itertools.product(NAMES[:10], NAMES[5:12]))
    lines = [f"{a}, {b}" for a, b in pairs]
    black, white = ["B. Clark"], ["M. Neil", "Amy Clark", "E Emile", "Mary O'Neil"]
    on_black, on_white = {"B. Clark"}, {"M. Neil", "Mary-Ann O'Neil", "A. Clark", "Amy Clark"}
    wanted = {
        i: "Priority" if on_white & set(pair) else "Other" for i, pair in enumerate(pairs) if not on_black & set(pair)
    }
    wanted[len(lines)] = "Other"
    corpus = _corpus(spark, lines)
    routed = authors.route_priority(corpus, _names(spark, black), _names(spark, white), **how)
    assert routed.columns == ["key", "content", "section"]
    assert {r.key: r.section for r in routed.collect()} == wanted
    kept = authors.exclude_authors(corpus, _names(spark, black), **how)
    assert sorted(r.key for r in kept.collect()) == sorted(wanted)
    counts = authors.routing_counts(corpus, _names(spark, black), _names(spark, white), **how).first()
    priority = sum(s == "Priority" for s in wanted.values())
    assert counts == (len(lines) + 1 - len(wanted), priority, len(wanted) - priority)


def test_empty_lists_keep_everything(spark):
    corpus = _corpus(spark, ["A One"])
    assert authors.exclude_authors(corpus, _names(spark, [])).count() == 2
    assert authors.exclude_authors(corpus, _names(spark, []), inline=0).count() == 2


@pytest.mark.parametrize("inline", [0, 500])
def test_flag_authors(spark, inline):
    cards = spark.createDataFrame([(1, "Jay Doe, Ann Clark,, X"), (2, "")], "id int, authors string")
    flagged = authors.flag_authors(cards, _names(spark, ["Amy Clark", "X"]), ["id"], inline)
    got = {r.id: [tuple(f) for f in r.flags] for r in flagged.collect()}
    assert got == {1: [("Jay Doe", False), ("Ann Clark", True), ("X", False)], 2: []}


def test_short_list_is_matched_inside_the_scan(spark):
    corpus = _corpus(spark, ["A One"])
    plan = plan_of(authors.route_priority(corpus, _names(spark, ["A One"]), _names(spark, ["B Two"])))
    assert "Join" not in plan and "Exchange" not in plan


def test_list_of_known_size_is_broadcast(spark, tmp_path):
    _names(spark, NAMES).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    plan = plan_of(authors.author_match(authors.explode_authors(_corpus(spark, ["A One"])), names))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_headers_spare_the_abstracts(spark, tmp_path):
    papers = spark.createDataFrame(
        [(1, "About Authors: X Y", ["Ann Clark"], "text"), (2, "T", ["Ann Clark", "X Y"], "Authors: no")],
        "key int, title string, authors array<string>, abstract string",
    ).selectExpr("*", "'u' AS url", "timestamp'2024-01-01' AS published")
    papers.write.parquet(str(tmp_path / "papers"))
    stored = spark.read.parquet(str(tmp_path / "papers"))
    names = _names(spark, ["A. Clark"])
    found = authors.matched_keys(render_headers(stored), {"hit": names})
    whole = authors.matched_keys(render_records(stored), {"hit": names})
    assert [r.key for r in found.collect()] == [r.key for r in whole.collect()] == [2]
    assert "abstract:" not in plan_of(found) and "abstract:" in plan_of(whole)


def test_common_name_is_split_by_adaptive_execution(spark, tmp_path):
    """One name holds most author rows; a list too large to broadcast still does not pile it up."""
    rows = spark.range(200_000).select(
        F.col("id").alias("key"),
        F.lit(0).alias("pos"),
        F.when(F.col("id") % 3 > 0, "Ann Clark").otherwise(F.concat(F.lit("A N"), "id")).alias("author"),
    )
    rows.write.parquet(str(tmp_path / "authors"))
    names = spark.range(50_000).select(F.concat(F.lit("A N"), F.col("id") * 6).alias("name"))
    names.unionByName(_names(spark, ["Ann Clark"])).write.parquet(str(tmp_path / "names"))
    wanted = sum(i % 3 > 0 or i % 6 == 0 for i in range(200_000))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet(str(tmp_path / "authors"))
        names = spark.read.parquet(str(tmp_path / "names"))
        found = authors.author_match(rows, names)
        assert len(found.collect()) == wanted and "skew=true" in plan_of(found)
        salted = authors.author_match(rows, names, salts=4)
        assert len(salted.collect()) == wanted
        records = rows.select("key", F.concat(F.lit("Authors: "), "author").alias("content"))
        matched = authors.matched_keys(records, {"hit": names})
        assert len(matched.collect()) == wanted and "skew=true" in plan_of(matched)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("how", [{}, {"inline": 0}, {"inline": 0, "stage": False}, {"inline": 1}])
def test_missing_fields_and_repeated_keys_are_routed_alike(spark, how):
    papers = spark.createDataFrame(
        [
            (1, "t", ["Ann Clark"], "a", None, "d"),
            (1, "t", ["Bo Li"], None, "u", "d"),
            (2, None, None, "a", "u", None),
            (3, "t", [], "a", "u", "d"),
            (4, "t", ["Amy Clark", "Bo Li"], "a", "u", "d"),
            (4, "t", ["Amy Clark", "Bo Li"], "a", "u", "d"),
        ],
        "key int, title string, authors array<string>, abstract string, url string, published string",
    )
    corpus = render_records(papers, raw_date=True).unionByName(spark.createDataFrame([(5, None)], "key int, content string"))
    black, white = _names(spark, ["B. Li", "Z Z"]), _names(spark, ["A. Clark"])
    routed = authors.route_priority(corpus, black, white, **how).collect()
    assert sorted((r.key, r.section) for r in routed) == [(1, "Priority"), (2, "Other"), (3, "Other"), (5, "Other")]
    assert sorted(r.key for r in authors.exclude_authors(corpus, _names(spark, []), **how).collect()) == [1, 1, 2, 3, 4, 4, 5]
    assert tuple(authors.routing_counts(corpus, black, white, **how).first()) == (3, 1, 3)


@pytest.mark.parametrize("inline", [0, 500])
def test_cards_of_one_key_stay_apart(spark, inline):
    cards = spark.createDataFrame([(1, "Ann Clark"), (1, "Bo Li"), (1, None)], "id int, authors string")
    flagged = authors.flag_authors(cards, _names(spark, ["A Clark"]), ["id"], inline).collect()
    assert sorted([tuple(f) for f in r.flags] for r in flagged) == [[], [("Ann Clark", True)], [("Bo Li", False)]]


def test_texts_are_not_shuffled_for_matched_lines_above_sparks_threshold(spark):
    rows = [(i, f"Title: t\nAuthors: Ann B{i}\nAbstract:\nx\nURL: u\nDate: d\n") for i in range(300)]
    corpus = spark.createDataFrame(rows, "key int, content string")
    black, white = (spark.createDataFrame([(f"A B{i}",) for i in keys], "name string") for keys in (range(0, 100), range(50, 200)))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "10b")
        routed = authors.route_priority(corpus, black, white, inline=0)
        assert "SortMergeJoin" not in plan_of(routed) and "BroadcastHashJoin" in plan_of(routed)
        found = {r.key: r.section for r in routed.collect()}
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert found == {i: "Priority" if i < 200 else "Other" for i in range(100, 300)}
