"""Quality rules: a learned decision list over native statistics.

Sequential covering: a rule is a conjunction of thresholds that grows by the best gain on two thirds
of the labelled rows and is pruned on the last third; the rows it covers leave and the next rule
grows. The list becomes one ordered conditional expression. Text statistics, counting and applying
are DataFrame functions; the driver sees counts for each threshold only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import WORD
from marginalia.session import staged

SYMBOLS = r"[#*$%&|<>]"  # fixed value
WINDOW = 5

#: Feature -> expression over the statistics. A text without words has 0 everywhere.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class ListOptions:
    per_class: int = 20_000  # labelled rows of each class that rules are learned on at most
    cuts: int = 40  # thresholds tried for a feature
    max_rules: int = 10
    max_conditions: int = 4
    min_precision: float = 0.6  # on the pruning rows, for a rule to be accepted
    min_covered: int = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """Base statistics and features of every text; a null text has no words.

    Repeated windows are found inside a row: windows are hashed, and only where two hashes agree are
    they sorted with their places; the words covered are the union of the windows' intervals.
    """
    ws = "words"
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", *carried, text.alias("text")).select(
        "doc_id", *carried, "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias(ws), lines.alias("lines")
    )
    window = lambda i: F.xxhash64(*[F.get(F.col(ws), i + k) for k in range(WINDOW)])
    hashes = F.when(F.size(ws) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), window)).otherwise(
        F.array().cast("array<bigint>")
    )
    second = first.select(
        "doc_id",
        *carried,
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        hashes.alias("hashes"),
    )
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    third = second.withColumn("placed", F.when(repeats, placed).otherwise(empty))
    twin = lambda e, k: (
        F.coalesce(F.get(F.col("placed"), k - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get(F.col("placed"), k + 1)["h"] == e["h"], F.lit(False))
    )
    starts = F.sort_array(F.transform(F.filter("placed", twin), lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-2 * WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    fourth = third.withColumn("n_repeat_words", covered.cast("long")).drop("hashes", "placed")
    return fourth.select("*", *[F.expr(expression).alias(name) for name, expression in FEATURES.items()])


def base_failed() -> Column:
    """Fixed rule over the statistics."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _covers(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """Information gained on the covered bad rows by narrowing (bad0, good0) to (bad, good)."""
    if not bad:
        return 0.0
    return bad * (math.log2((bad + 1) / (bad + good + 2)) - math.log2((bad0 + 1) / (bad0 + good0 + 2)))


#: Weighted sums of either class.
SIDES = ("sum(weight * (1 - label)) AS bad", "sum(weight * label) AS good")


def _best(rows: DataFrame, cuts: dict[str, list[float]], bad0: float, good0: float) -> tuple[Condition, float] | None:
    """The condition of the highest gain over `rows`, by one aggregate over (feature, interval)."""
    pairs = ", ".join(f"'{f}', bin_{f}" for f in cuts)
    counts = (
        rows.select("label", "weight", F.expr(f"stack({len(cuts)}, {pairs}) AS (feature, bin)"))
        .groupBy("feature", "bin")
        .agg(*map(F.expr, SIDES))
        .collect()
    )
    best: tuple[Condition, float] | None = None
    for feature, borders in cuts.items():
        own = {r.bin: (r.bad, r.good) for r in counts if r.feature == feature}
        bad = good = 0
        for k, border in enumerate(borders):
            bad, good = bad + own.get(k, (0, 0))[0], good + own.get(k, (0, 0))[1]
            for above, b, g in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                gain = _gain(b, g, bad0, good0)
                if gain > 1e-9 and (best is None or gain > best[1] + 1e-9):
                    best = (Condition(feature, above, border), gain)
    return best


def learn(labelled: DataFrame, options: ListOptions = ListOptions()) -> list[Rule]:
    """Ordered rejection rules from rows of (doc_id, label, weight, features...); label 0 is the class to reject.

    A row counts as `weight` rows, but for the least number of rows that a rule must cover.

    The rows are staged once; each step is a small aggregate over them. Without bad rows there is no
    rule. Ties go to the feature named first and the lowest threshold.
    """
    rows = labelled.select("doc_id", "label", "weight", *FEATURES)
    rows = staged(rows, "list-rows")
    points = [(k + 0.5) / options.cuts for k in range(options.cuts)]
    found = rows.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES if found[f] is not None}
    if not cuts:
        return []
    bins = {f: sum((F.col(f) > F.lit(c)).cast("int") for c in borders) for f, borders in cuts.items()}
    rows = staged(
        rows.select("*", *[b.alias(f"bin_{f}") for f, b in bins.items()], (F.abs(F.xxhash64("doc_id", F.lit("prune"))) % 3 == 0).alias("prunes")),
        "list-bins",
    )
    rules: list[Rule] = []
    left = rows
    while len(rules) < options.max_rules:
        grows = left.where(~F.col("prunes"))
        rule: list[Condition] = []
        while len(rule) < options.max_conditions:
            here = grows.where(_covers(tuple(rule)))
            total = here.agg(*map(F.expr, SIDES)).first()
            bad0, good0 = total.bad or 0, total.good or 0
            if not bad0 or not good0 and rule:
                break
            step = _best(here, cuts, bad0, good0)
            if step is None:
                break
            rule.append(step[0])
        if not rule:
            break
        sides = []
        for k in range(1, len(rule) + 1):
            cover = _covers(tuple(rule[:k]))
            sides += [F.sum(F.when(cover & (F.col("label") == s), F.col("weight")).otherwise(0.0)).alias(f"n{k}_{s}") for s in (0, 1)]
            sides.append(F.count(F.when(cover & (F.col("label") == 0), 1)).alias(f"rows{k}"))
        counts = left.where("prunes").agg(*sides).first()
        worth = [((counts[f"n{k}_0"] or 0), (counts[f"n{k}_1"] or 0)) for k in range(1, len(rule) + 1)]
        value = [(b - g) / (b + g) if b + g else -1.0 for b, g in worth]
        k = max(range(len(rule)), key=lambda i: (value[i], -i))
        bad, good = worth[k]
        if counts[f"rows{k + 1}"] < options.min_covered or bad / max(bad + good, 1) < options.min_precision:
            break
        rules.append(tuple(rule[: k + 1]))
        left = left.where(~_covers(rules[-1]))
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired from 1, else 0) as ordered conditional expressions."""
    kept, fired = F.when(F.lit(False), F.lit(False)), F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        kept, fired = kept.when(_covers(rule), F.lit(False)), fired.when(_covers(rule), F.lit(number))
    return kept.otherwise(F.lit(True)), fired.otherwise(F.lit(0))


def quality_rules(docs: DataFrame, labelled: DataFrame, options: ListOptions = ListOptions()) -> DataFrame:
    """Statistics, base rule and learned verdict of every row of `docs`.

    `labelled` holds (doc_id, label, weight) of at most 2 x `per_class` rows, so it is safe to broadcast. The
    features of those rows are computed once more for learning; no text is shuffled.
    """
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id"), "label", "weight")
    kept, fired = verdict(learn(rows, options))
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), fired.alias("rule"), (~base_failed() & kept).alias("kept"), *FEATURES,
    )
