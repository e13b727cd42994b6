"""Author lists, fuzzy name matching and routing.

Two names match when both have a last name, the last names are equal, and

* strict: the first names are equal, or share the initial while one of them is one letter;
* loose: the first names share the initial.

Both rules are turned into equality of (last, token) pairs. A listed name offers every token it
can be met by and a candidate asks for the tokens it can meet, so that matching is a hash join
(or a set lookup) and never a comparison of all names with all names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import strings as S
from marginalia.session import staged

# Characters of a name that count as spaces.
NAME_PUNCTUATION = ",.\"'-_()"

PRIORITY = "Priority"
OTHER = "Other"

# Listed names up to this number are matched inside the scan, without explode, join or shuffle.
INLINE_NAMES = 500

# Author lines that hold a listed name are broadcast up to this size in memory, instead of the texts being shuffled.
LINE_BYTES = 256 * 1024 * 1024
LINE_OVERHEAD = 64


def name_parts(name: Column) -> Column:
    return S.words(F.translate(F.lower(name), NAME_PUNCTUATION, " " * len(NAME_PUNCTUATION)))


def _first(parts: Column) -> Column:
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def _last(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def normalize_names(df: DataFrame, column: str) -> DataFrame:
    """Add `first` and `last`, the first and the last word of the normalised name."""
    parts = name_parts(F.col(column))
    return df.withColumns({"first": _first(parts), "last": _last(parts)})


def author_names(line: Column) -> Column:
    """An authors line to an array of names; repeated labels inside it are removed."""
    bare = F.replace(line, F.lit("Authors:"), F.lit(""))
    return F.filter(F.transform(F.split(bare, ","), S.strip), lambda a: a != "")


def explode_authors(corpus: DataFrame) -> DataFrame:
    """(key, content) to (key, pos, author); a record without authors has no rows.

    An inner explode would let Spark infer a filter on the number of names and move it to the scan, where
    every line would be taken apart a few times more. So here, and for tokens, rows without items go afterwards.
    """
    names = author_names(S.line_field(F.col("content"), "Authors:"))
    return corpus.select("key", F.posexplode_outer(names).alias("pos", "author")).where(F.col("pos").isNotNull())


def _spell(parts: Column, tokens: Column) -> Column:
    """Last name, a tab (which no word can hold) and each token; nothing when the name has no last name."""
    spelled = F.transform(tokens, lambda t: F.concat(_last(parts), F.lit("\t"), t))
    return F.when(F.size(parts) > 1, spelled).otherwise(F.array().cast("array<string>"))


def _asked(parts: Column, mode: str) -> Column:
    """Tokens by which a candidate with these name parts can be met."""
    first = _first(parts)
    initial = F.substring(first, 1, 1)
    if mode == "loose":
        return _spell(parts, F.array(initial))
    return _spell(
        parts,
        F.when(F.length(first) == 1, F.array(F.concat(F.lit("."), first))).otherwise(
            F.array(F.concat(F.lit("="), first), F.concat(F.lit("*"), initial))
        ),
    )


def _offered(parts: Column, mode: str) -> Column:
    """Tokens by which a listed name with these parts can be met."""
    first = _first(parts)
    initial = F.substring(first, 1, 1)
    if mode == "loose":
        return _spell(parts, F.array(initial))
    own = F.when(F.length(first) == 1, F.concat(F.lit("*"), first)).otherwise(F.concat(F.lit("="), first))
    return _spell(parts, F.array(F.concat(F.lit("."), initial), own))


def _asked_by(authors: Column, mode: str) -> Column:
    """Array of author names to the array of their token arrays; each name is taken apart once."""
    return F.transform(F.transform(authors, name_parts), lambda parts: _asked(parts, mode))


def _tokens(spell, name: str, mode: str) -> Column:
    """The tokens that `_asked` or `_offered` makes of the column `name`, one a row or NULL; a name is taken apart once."""
    return F.explode_outer(F.flatten(F.transform(F.transform(F.array(name), name_parts), lambda parts: spell(parts, mode)))).alias("token")


def _name_tokens(names: DataFrame, mode: str) -> DataFrame:
    return names.select(_tokens(_offered, "name", mode)).where(F.col("token").isNotNull())


def _check_mode(mode: str) -> None:
    if mode not in ("strict", "loose"):
        raise ValueError(f"mode must be 'strict' or 'loose', not {mode!r}")


def author_match(authors: DataFrame, names: DataFrame, mode: str = "strict", salts: int = 1) -> DataFrame:
    """Rows of `authors` (key, pos, author) that match any of `names` (name).

    Spark broadcasts a small list. A list too large for that is joined by shuffle, where a common
    name is split by adaptive skew handling, or by `salts` copies of the list. (The list is not made
    distinct: a semi join has no use for it, and an aggregate between shuffle and join would keep
    adaptive execution from splitting.)
    """
    _check_mode(mode)
    asked = authors.select("*", _tokens(_asked, "author", mode)).where(F.col("token").isNotNull())
    tokens = _name_tokens(names, mode)
    on = ["token"]
    if salts > 1:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(salts)).cast("int"))
        tokens = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("salt")
    hits = asked.join(tokens, on, "left_semi").drop(*on)
    # A loose candidate asks for one token only, so it cannot be met twice.
    return hits if mode == "loose" else hits.dropDuplicates(["key", "pos"])


def _inline_tokens(lists: dict[str, DataFrame], mode: str, limit: int) -> dict[str, Column]:
    """The tokens of each list of at most `limit` names, as a constant array.

    Runs one job that reads and returns at most `limit` + 1 names of each list, however long it is.
    """
    if limit <= 0:
        return {}
    cut = [
        names.limit(limit + 1).select(F.lit(tag).alias("tag"), _offered(name_parts(F.col("name")), mode).alias("tokens"))
        for tag, names in lists.items()
    ]
    rows = reduce(DataFrame.unionByName, cut).collect()
    found = {}
    for tag in lists:
        own = [row.tokens for row in rows if row.tag == tag]
        if len(own) <= limit:
            tokens = sorted({token for some in own for token in some or ()})
            found[tag] = F.split(F.lit("\n".join(tokens)), "\n") if tokens else F.array().cast("array<string>")
    return found


def _meets(asked: Column, tokens: Column) -> Column:
    return F.coalesce(F.arrays_overlap(asked, tokens), F.lit(False))


def matched_keys(corpus: DataFrame, lists: dict[str, DataFrame], stage: bool = True) -> DataFrame:
    """(key, one BOOLEAN per list) for the records with an author on any of the lists.

    All lists are looked up in one join; only matching rows are shuffled by key. With `stage` the
    lists' tokens are written first: their size is then known, and if it asks for a shuffle join,
    adaptive execution can split a common name there.
    """
    mode = "strict"
    tagged = [
        _name_tokens(names, mode).select("token", *[F.lit(tag == t).alias(t) for t in lists])
        for tag, names in lists.items()
    ]
    flags = [F.max(t).alias(t) for t in lists]
    tokens = reduce(DataFrame.unionByName, tagged).groupBy("token").agg(*flags)
    if stage:
        tokens = staged(tokens, "name-tokens")
    asked = explode_authors(corpus).select("key", _tokens(_asked, "author", mode)).where(F.col("token").isNotNull())
    return asked.join(tokens, "token").groupBy("key").agg(*flags)


def _hinted(matched: DataFrame) -> DataFrame:
    """The written `matched` (_line, flags), to be broadcast if it fits into `LINE_BYTES`. Runs a job.

    Spark's own threshold is passed long before that, and beyond it all texts would be shuffled and sorted by
    their author lines. A session that has turned broadcasts off keeps them off.
    """
    threshold = matched.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if threshold.startswith("-"):
        return matched
    size = matched.agg(F.sum(F.octet_length("_line") + F.lit(LINE_OVERHEAD))).first()[0]
    return F.broadcast(matched) if (size or 0) <= LINE_BYTES else matched


def _flagged(
    corpus: DataFrame,
    lists: dict[str, DataFrame],
    inline: int = INLINE_NAMES,
    stage: bool = True,
    headers: DataFrame | None = None,
) -> DataFrame:
    """`corpus` with one BOOLEAN per list: does the record have an author on it (strict match)?

    A short list becomes a row-local set test. For a longer one the author lines that hold a listed
    name are found and joined back, so that both ways decide by the row's own line, whatever its key;
    a record without content or authors is on no list. With `stage` the lines found are written to the
    shared scratch folder first, so that Spark knows their size before it decides whether the wide
    corpus has to be shuffled for that join. `headers` is the same corpus cut down to the lines up to
    the authors, if there is a cheaper way to read it.
    """
    line = F.coalesce(S.line_field(F.col("content"), "Authors:"), F.lit(""))
    asked = F.flatten(_asked_by(author_names(line), "strict"))
    short = {tag: _meets(asked, tokens) for tag, tokens in _inline_tokens(lists, "strict", inline).items()}
    long = {tag: listed for tag, listed in lists.items() if tag not in short}
    flagged = corpus.withColumns(short) if short else corpus
    if long:
        lines = (corpus if headers is None else headers).select(line.alias("key"))
        lines = lines.withColumn("content", F.concat(F.lit("Authors: "), "key", F.lit("\n")))
        matched = matched_keys(lines, long, stage).withColumnRenamed("key", "_line")
        if stage:
            matched = _hinted(staged(matched, "matched-lines"))
        # Rows without authors match nothing; a key of their own each keeps them from meeting in one task.
        apart = F.concat(F.lit("\0"), F.xxhash64("key", "content").cast("string"))
        flagged = flagged.withColumn("_line", F.when(line == "", apart).otherwise(line)).join(matched, "_line", "left").fillna(False, list(long)).drop("_line")
    return flagged


def exclude_authors(corpus: DataFrame, names: DataFrame, **how) -> DataFrame:
    """Records without any listed author; an empty list keeps everything."""
    return _flagged(corpus, {"_black": names}, **how).where(~F.col("_black")).drop("_black")


def route_priority(corpus: DataFrame, black: DataFrame, white: DataFrame, **how) -> DataFrame:
    """Drop blacklisted records; add `section`: Priority for whitelisted ones, else Other."""
    flagged = _flagged(corpus, {"_black": black, "_white": white}, **how)
    section = F.when(F.col("_white"), PRIORITY).otherwise(OTHER)
    return flagged.where(~F.col("_black")).withColumn("section", section).drop("_black", "_white")


def routing_counts(corpus: DataFrame, black: DataFrame, white: DataFrame, **how) -> DataFrame:
    """One row: how many records are blacklisted, go to Priority, and go to Other."""
    flagged = _flagged(corpus, {"_black": black, "_white": white}, **how)
    return flagged.agg(
        F.count_if("_black").alias("blacklisted"),
        F.count_if(~F.col("_black") & F.col("_white")).alias("priority"),
        F.count_if(~F.col("_black") & ~F.col("_white")).alias("rest"),
    )


def flag_authors(cards: DataFrame, names: DataFrame, by: list[str], inline: int = INLINE_NAMES) -> DataFrame:
    """`by` columns and `flags` = all authors in order as ARRAY<STRUCT<name, hit>> (loose match).

    `authors` is a card's comma-separated line, NULL being an empty one. Every row of `cards` is a card
    of its own, also when `by` repeats.
    """
    authors = author_names(F.coalesce("authors", F.lit("")))
    tokens = _inline_tokens({"listed": names}, "loose", inline).get("listed")
    if tokens is not None:
        flags = F.zip_with(
            authors,
            _asked_by(authors, "loose"),
            lambda a, asked: F.struct(a.alias("name"), _meets(asked, tokens).alias("hit")),
        )
        return cards.select(*by, flags.alias("flags"))
    listed = staged(_name_tokens(names, "loose").distinct().withColumn("hit", F.lit(True)), "name-tokens")
    cards = cards.withColumn("_card", F.monotonically_increasing_id())
    parts = cards.select("_card", *by, F.posexplode_outer(authors).alias("pos", "name")).withColumn(
        "token", F.get(_asked(name_parts(F.col("name")), "loose"), F.lit(0))
    )
    # A group is the author line of one card, which was one value before.
    entry = F.struct("pos", "name", F.coalesce("hit", F.lit(False)).alias("hit"))
    grouped = parts.join(listed, "token", "left").groupBy("_card", *by).agg(
        F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), entry))).alias("flags")
    )
    return grouped.drop("_card").withColumn("flags", F.transform("flags", lambda f: F.struct(f["name"].alias("name"), f["hit"].alias("hit"))))
