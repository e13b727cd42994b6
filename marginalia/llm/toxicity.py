"""Toxicity: two class-conditional Kneser-Ney models that share their backoff.

Each class has an interpolated bigram model over the labelled rows: bigram counts with absolute discounts for
counts of one, two, and more, estimated from the counts of counts; then discounted counts of distinct predecessors;
then one distribution that both classes share: in how many of all documents a word occurs. Whatever was seen
keeps a part of its count, also if it was seen once, and a rare expression weighs the less the more
documents hold it anywhere. A text is compared by the difference of its two log-likelihoods over its length: under
the bigram models for the whole text, and under the distributions they back off to, which rare pairs do not
disturb, for the whole text, its most suspicious window, word, and fiftieth of all words. A language or a subject
shifts all words of a text alike, so the median word's difference is taken off. Both classes are trained on
equally many rows, and rows that trained no model calibrate the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fit_logistic, give_back_memory, labelled_ids, logistic, map_batches, texts_of
from marginalia.session import staged

#: What lies between words: all but letters and numbers.
BETWEEN = r"[^\pL\pN]+"
START = ""
FEATURES = 6
#: The share of a text's words, one in so many, that are compared as its most suspicious ones.
TOP = 50
#: Partial counts that a task holds before it hands them on.
PARTIAL_ROWS = 1 << 19


@dataclass(frozen=True)
class ToxicOptions:
    """Bounds of the fit on labelled rows; shared counts cover all documents."""

    per_class: int = 2000  # labelled documents of each class that are read at most
    window: int = 25
    calibrating: float = 0.25  # the share of them that trains no model, beside what one class has more than the other
    ridge: float = 1e-3
    modulus: int = 5
    held_out: int = 0


@dataclass
class Model:
    """Log ratios of the two models: toxic over ordinary."""

    words: pa.Array  # known words; ids are their places from 1 on, 0 is any other word, the start of a text is a word
    unigram: np.ndarray  # by id: of the backoff distributions of a word
    lead: np.ndarray  # by id of the previous word: of the shares that go to the backoff
    pairs: np.ndarray  # previous id << 32 | id of the bigrams seen in either class, ascending
    bigram: np.ndarray  # their ratios
    weights: np.ndarray


def token_lists(texts: pa.Array) -> pa.LargeListArray:
    """Lower-case words of every text."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), BETWEEN)
    flat, parents = split.flatten(), pc.list_parent_indices(split).to_numpy()
    there = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(parents[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)), flat.filter(there))


def discounts(counts: np.ndarray) -> np.ndarray:
    """How much is taken off a count of 0, 1, 2, and 3 or more, from how many counts there are of each size."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    share = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    found = [0.0]
    for k in (1, 2, 3):
        found.append(k - (k + 1) * share * n[k + 1] / n[k] if n[k] else 0.5)
    return np.clip(found, 0.0, [0.0, 0.99, 1.99, 2.99])


def _taken_off(counts: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, off[np.minimum(counts, 3)], 0.0)


def build(words: pa.Array, documents: np.ndarray, others: float, previous: np.ndarray, word: np.ndarray, counts: np.ndarray) -> Model:
    """The pair of models from the distinct bigrams of both classes.

    `words` are all known ones, `documents` in how many of all documents each occurs, and `others` the sum of these
    numbers, and one more each, of all other words. The bigrams are ids of `words` from 1 on, with a row of
    (toxic, ordinary) counts each.
    """
    shared = np.concatenate([[others + 1.0], documents + 1.0])
    shared /= shared.sum()
    size = len(words) + 1
    lower, backs, own = [], [], []
    for side in (0, 1):
        n = counts[:, side]
        kinds = np.bincount(word[n > 0], minlength=size)  # distinct predecessors of each word
        off = _taken_off(kinds, discounts(kinds[kinds > 0]))
        total = max(kinds.sum(), 1)
        lower.append((kinds - off) / total + (off.sum() / total if kinds.any() else 1.0) * shared)
        off = _taken_off(n, discounts(n[n > 0]))
        after = np.bincount(previous, n, size)
        backs.append(np.where(after > 0, np.bincount(previous, off, size) / np.maximum(after, 1), 1.0))
        own.append((n - off) / np.maximum(after[previous], 1))
    both = [own[side] + backs[side][previous] * lower[side][word] for side in (0, 1)]
    keys = previous.astype(np.int64) << 32 | word
    order = np.argsort(keys)
    bigram = (np.log(both[0]) - np.log(both[1]))[order]
    return Model(
        words, np.log(lower[0]) - np.log(lower[1]), np.log(backs[0]) - np.log(backs[1]), keys[order], bigram, np.zeros(0)
    )


def _ids(lists: pa.LargeListArray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The id of every word of all lists in turn, and that of the word before it."""
    coded = lists.flatten().dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=model.words)
    ids = (pc.fill_null(known, -1).to_numpy().astype(np.int64) + 1)[coded.indices.to_numpy()]
    previous = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    first = lists.offsets.to_numpy()[:-1]
    previous[first[first < len(ids)]] = pc.index(model.words, START).as_py() + 1
    return ids, previous


def word_ratios(lists: pa.LargeListArray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios, toxic over ordinary, of each word of all lists in turn: given the word before it, and in the backoff."""
    ids, previous = _ids(lists, model)
    lower = model.unigram[ids]
    ratios = lower + model.lead[previous]
    if len(model.pairs) and len(ids):
        asked = np.flatnonzero((ids > 0) & (previous > 0))
        keys = previous[asked] << 32 | ids[asked]
        at = np.minimum(np.searchsorted(model.pairs, keys), len(model.pairs) - 1)
        hit = model.pairs[at] == keys
        ratios[asked[hit]] = model.bigram[at[hit]]
    return ratios, lower


def features(texts: pa.Array, model: Model, window: int) -> np.ndarray:
    """Per text, without the median word's: the mean ratio; then of the backoff the mean ratio, that of the best window, of the
    highest fiftieth of the words, and of the highest word; and the logarithm of the length.

    All 0 without words. A text shorter than a window is one window.
    """
    lists = token_lists(texts)
    ratios, lower = word_ratios(lists, model)
    bounds = lists.offsets.to_numpy()
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), FEATURES))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    first, last, size = bounds[:-1][filled], bounds[1:][filled], sizes[filled]
    doc = np.repeat(np.arange(len(filled)), size)

    def sums(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(values)])

    for column, values in ((0, ratios), (1, lower)):
        ranked = values[np.lexsort((values, doc))]
        median = ranked[first + size // 2]
        total = sums(values)
        out[filled, column] = (total[last] - total[first]) / size - median
    # Every word ends the window of the words before it, which the start of the text may cut short.
    begin = np.maximum(np.arange(len(lower)) + 1 - window, np.repeat(first, size))
    means = (total[1:] - total[begin]) / np.repeat(np.minimum(size, window), size)
    out[filled, 2] = np.maximum.reduceat(means, first) - median
    top = np.maximum(size // TOP, 1)
    highest = sums(ranked)
    out[filled, 3] = (highest[last] - highest[last - top]) / top - median
    out[filled, 4] = ranked[last - 1] - median
    out[filled, 5] = np.log1p(size)
    return out


def _bigrams(rows: DataFrame) -> DataFrame:
    """(previous, word, toxic, ordinary): in how many documents of each class each bigram occurs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = token_lists(batch.column("text"))
        word = lists.flatten()
        doc = pc.list_parent_indices(lists)
        values = word.to_pylist()
        previous = [START, *values[:-1]]
        for at in lists.offsets.to_numpy()[:-1].tolist():
            if at < len(previous):
                previous[at] = START
        pairs = pa.table({"doc": doc, "previous": pa.array(previous[: len(values)], pa.string()), "word": word.cast(pa.string())})
        once = pairs.group_by(["doc", "previous", "word"]).aggregate([])
        toxic = batch.column("label").cast(pa.int64()).take(once.column("doc").combine_chunks())
        made = pa.table({"previous": once.column("previous"), "word": once.column("word"), "toxic": toxic, "ordinary": pc.subtract(1, toxic)})
        made = made.group_by(["previous", "word"]).aggregate([("toxic", "sum"), ("ordinary", "sum")])
        return made.rename_columns(["previous", "word", "toxic", "ordinary"]).combine_chunks().to_batches()[0] if made.num_rows else None

    made = map_batches(rows, work, "previous string, word string, toxic bigint, ordinary bigint")
    return made.groupBy("previous", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _document_counts(docs: DataFrame) -> DataFrame:
    """(word, n): in how many of all documents each word of theirs occurs; summed up by every task before the shuffle."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        made = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": made.column("word"), "n": made.column("n_sum")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = least = 0
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                lists = token_lists(batch.column("text"))
                words = pa.table({"doc": pc.list_parent_indices(lists), "word": lists.flatten().cast(pa.string())})
                once = words.group_by(["doc", "word"]).aggregate([]).group_by("word").aggregate([([], "count_all")])
                waiting.append(pa.table({"word": once.column("word"), "n": once.column("count_all")}))
                rows += len(once)
                if rows > PARTIAL_ROWS + 2 * least:
                    waiting = [summed(waiting)]
                    rows = least = len(waiting[0])
                    if rows > PARTIAL_ROWS:
                        yield from waiting.pop().to_batches(max_chunksize=50_000)
                        rows = least = 0
        if waiting:
            yield from summed(waiting).to_batches(max_chunksize=50_000)
        give_back_memory()

    return texts_of(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _shared_counts(counts: DataFrame, known: DataFrame) -> tuple[pa.Table, float]:
    """Document counts (word, n) of the `known` words, and what the others weigh together: their counts and one more each."""
    shared = counts.join(known, "word", "left_semi").toArrow()
    every = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    return shared, float((every.n or 0) - (pc.sum(shared.column("n")).as_py() or 0) + every.words - len(shared))


def fit(docs: DataFrame, labels: DataFrame, options: ToxicOptions = ToxicOptions()) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    A part of the sample (by a hash of the id), about as many rows of either class, gives class counts, all of
    which are kept; the rest calibrates. The shared backoff counts every document of the table. Without labels of both classes the score
    is constant. The driver holds the distinct bigrams of the sample, which `per_class` bounds.
    """
    spark = docs.sparkSession
    ids = labelled_ids(labels, "toxic", options.modulus, options.held_out, options.per_class)
    place = [F.pmod(F.xxhash64("doc_id", F.lit(use)), F.lit(1 << 20)) / (1 << 20) for use in ("calibrate", "train")]
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id").select("label", "weight", "text", place[0].alias("part"), place[1].alias("place"))
    chosen = staged(rows, "toxic-rows")
    sizes = {r.label: r for r in chosen.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    share = {side: min(r.n for r in sizes.values()) / r.n for side, r in sizes.items()} if len(sizes) == 2 else {0: 1.0, 1: 1.0}
    equal = F.col("place") < F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    trains = (F.col("part") >= options.calibrating) & equal
    found = staged(_bigrams(chosen.where(trains).select("label", "text")), "toxic-counts")
    shared, others = _shared_counts(staged(_document_counts(docs), "toxic-words"), found.select("word").distinct())
    # Every word precedes another one or ends a text, so all are among the words; only the start is not.
    words = pa.concat_arrays([pa.array([START], pa.large_string()), shared.column("word").combine_chunks().cast(pa.large_string())])
    documents = np.concatenate([[0.0], shared.column("n").to_numpy()])
    table = found.toArrow()
    places = [pc.index_in(table.column(c).combine_chunks().cast(pa.large_string()), value_set=words).to_numpy().astype(np.int64) + 1 for c in ("previous", "word")]
    counts = np.stack([table.column(c).to_numpy() for c in ("toxic", "ordinary")], axis=1)
    model = build(words, documents, others, *places, counts)
    del table, places, counts
    sent = spark.sparkContext.broadcast(model)
    rows = _features_of(chosen.where(~trains).select("label", "text"), sent, options.window).collect()
    x, y = np.array([r.features for r in rows]).reshape(-1, FEATURES), np.array([r.label for r in rows], dtype=float)
    # Rows of a class stand for all its rows, so that the classes keep their shares.
    weight = np.array([sizes[r.label].weight for r in rows]) / np.maximum(np.where(y == 1, y.sum(), (1 - y).sum()), 1)
    if len(set(y)) < 2:
        model.weights = np.zeros(FEATURES + 1)
        known = [sizes[side].weight if side in sizes else 0.0 for side in (1, 0)]
        model.weights[-1] = math.log((known[0] + 0.5) / (known[1] + 0.5))
    else:
        model.weights = fit_logistic(x, y, ridge=options.ridge, counts=weight / weight.min())
    return model


def _features_of(rows: DataFrame, model: Broadcast, window: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = features(batch.column("text"), model.value, window).tolist()
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "features"])

    return map_batches(rows, work, "label int, features array<double>")


def score(docs: DataFrame, model: Model, options: ToxicOptions = ToxicOptions()) -> DataFrame:
    """(doc_id, score, mean, best_window) of every row; the latter two are the first and third of `features`.

    A null text is an empty one, whose score is that of no evidence; rows that repeat are scored each; an empty
    table gives no rows; a text of any length is scored whole; other columns than doc_id and text are not read. The
    model is broadcast: its size is bounded by the sample of labelled rows, whatever the table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text"), sent.value, options.window)
        columns = [batch.column("doc_id"), pa.array(logistic(x, sent.value.weights)), pa.array(x[:, 0]), pa.array(x[:, 2])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "mean", "best_window"])

    return map_batches(texts_of(docs), work, "doc_id bigint, score double, mean double, best_window double")
