"""Cross-tokenizer alignment over Arrow arrays.

Two tokenizers cut the same bytes of a text. The token lists of many texts are flattened beside their parent
indices; cumulative sums of token lengths, taken per document, give the byte offsets where tokens end. A hash
join on (document, end) finds the offsets where both end, which cut a text into groups. Tokens of both whose bytes
overlap are links; grouped by id pair they become partial counts, which Spark merges over the corpus.

Texts are tokenized once: a staged table holds each text's distinct pairs. Its second reading looks up how
often a pair is linked in the whole corpus. Frequent pairs, of bounded number, are looked up in the task;
the others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import give_back_memory
from marginalia.session import staged

#: Bytes of text that are worked on at once, or one text; results do not depend on it.
SLICE_BYTES = 2_000_000
#: The pattern by which byte-level vocabularies of this family cut a text into words. A fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALIGNED_SCHEMA = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)
_TOKENIZERS: dict[tuple[str, str], "Tokenizers"] = {}


@dataclass(frozen=True)
class AlignOptions:
    byte_vocabulary: str  # a byte-level vocabulary (JSON); it reads a space and the text
    piece_vocabulary: str  # a sentencepiece model; it puts the space there itself
    known_pairs: int = 1 << 20  # frequent pairs that every task may hold; others are joined
    partial_rows: int = 1 << 20  # partial counts that a task holds before it hands them on


@dataclass
class Alignment:
    """Staged tables of an alignment."""

    texts: DataFrame  # ALIGNED_SCHEMA; a pair is the second tokenizer's id << 32 | the first one's
    counts: DataFrame  # pair, n, best


def _letter_bytes() -> dict[str, int]:
    """The byte for which byte-level vocabularies write each printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if byte := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
        return bytes([int(byte[1], 16)])
    return piece.replace("▁", " ").encode()


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the text that stands for a token in a digest.

    The first vocabulary's ids ascend in order of its merges, so they serve as the ranks of a faster encoder
    that gives the same ids and knows no special tokens.
    """

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_vocabulary, encoding="utf-8") as file:
            given = json.load(file)
        special = {t["content"] for t in given.get("added_tokens", ())}
        letters = _letter_bytes()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in given["model"]["vocab"].items() if t not in special}
        self.first = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        by_id = {i: token for token, i in ranks.items()}
        self.size = max(by_id) + 1
        pieces = range(self.second.get_piece_size())
        self.first_bytes = pa.array([by_id.get(i, b"") for i in range(self.size)], pa.large_binary())
        self.second_bytes = pa.array([_piece_bytes(self.second.id_to_piece(i)) for i in pieces], pa.large_binary())
        names = [b"%d" % i for i in range(max(self.size, len(pieces)))]
        # A token's text with what follows it: within its side of a group, at that side's end, at the text's end.
        self.names = pa.array([n + mark for mark in (b",", b"|", b";", b"") for n in names], pa.large_binary())
        self.stride = len(names)

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        first = [self.first.encode_to_numpy(" " + text, disallowed_special=()) for text in texts]
        second = [np.array(ids, np.int64) for ids in self.second.encode(texts, num_threads=1)]
        return _lists(first), _lists(second)


def tokenizers(options: AlignOptions) -> Tokenizers:
    """The tokenizers of two vocabulary files, one pair per Python worker."""
    key = (options.byte_vocabulary, options.piece_vocabulary)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(*key)
    return _TOKENIZERS[key]


def _lists(values: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    flat = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _bounds(lists: pa.LargeListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _joined(lists: pa.LargeListArray, token_bytes: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All token bytes in a row, and where each token begins in them (and the last one ends)."""
    made = token_bytes.take(lists.flatten())
    _, offsets, data = made.buffers()
    starts = np.frombuffer(offsets, np.int64)[made.offset : made.offset + len(made) + 1] if len(made) else np.zeros(1, np.int64)
    return memoryview(data or b"").cast("B"), starts


def _spelled(lists: pa.LargeListArray, token_bytes: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list's tokens are the wanted ones."""
    data, starts = _joined(lists, token_bytes)
    ends = starts[_bounds(lists)]
    return np.array([data[a:b] == w for a, b, w in zip(ends[:-1], ends[1:], wanted, strict=True)], bool)


def _ended(lists: pa.LargeListArray, token_bytes: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """(doc, end, at) of every token, its end counted from its document's start; and the token starts over all documents."""
    _, starts = _joined(lists, token_bytes)
    doc = pc.list_parent_indices(lists)
    end = pc.subtract(pa.array(starts[1:]), pa.array(starts[_bounds(lists)[:-1]]).take(doc))
    return pa.table({"doc": doc, "end": end, "at": pa.array(np.arange(len(doc)))}), starts


def _order_of_groups(last_a: np.ndarray, last_b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of both sides when groups come in turn, the first side's tokens before the second's."""
    group_a, group_b = (np.searchsorted(last, np.arange(n)) for last, n in ((last_a, n_a), (last_b, n_b)))
    before_b = np.concatenate([[0], last_b + 1])
    return np.arange(n_a) + before_b[group_a], np.arange(n_b) + last_a[group_b] + 1


def align_texts(texts: list[str | None], tools: Tokenizers) -> dict[str, Any]:
    """The columns of ALIGNED_SCHEMA but the first two, for some texts."""
    filled = [i for i, t in enumerate(texts) if t]
    a, b = tools.encode([texts[i] for i in filled])
    wanted = [b" " + texts[i].encode() for i in filled]
    same = _spelled(a, tools.first_bytes, wanted) & _spelled(b, tools.second_bytes, wanted)
    kept = np.array(filled, np.int64)[same]
    a, b = (lists.filter(pa.array(same, pa.bool_())) for lists in (a, b))
    n = len(kept)
    (ends_a, starts_a), (ends_b, starts_b) = _ended(a, tools.first_bytes), _ended(b, tools.second_bytes)
    ids_a, ids_b = a.flatten().to_numpy(), b.flatten().to_numpy()
    bounds_a, bounds_b = _bounds(a), _bounds(b)

    shared = ends_a.join(ends_b, keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("at")
    last_a, last_b = shared.column("at").to_numpy(), shared.column("at_b").to_numpy()

    # Overlaps: from the first token of the other side that ends behind this one's start to the last that starts before its end.
    first = np.searchsorted(starts_b[1:], starts_a[:-1], side="right")
    many = np.searchsorted(starts_b[:-1], starts_a[1:], side="left") - first
    at_a = np.repeat(np.arange(len(ids_a)), many)
    at_b = np.arange(len(at_a)) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(at_a) else at_a
    links = pa.table({"doc": ends_a.column("doc").take(pa.array(at_a)), "pair": pa.array(ids_b[at_b] << 32 | ids_a[at_a])})
    counted = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")

    def per_text(values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(texts), np.int64)
        found[kept] = values
        return found

    def counts_of(column: pa.ChunkedArray) -> np.ndarray:
        return np.bincount(column.to_numpy(), minlength=n)[:n]

    to_a, to_b = _order_of_groups(last_a, last_b, len(ids_a), len(ids_b))
    kind = np.zeros(len(ids_a) + len(ids_b), np.int64)  # 0 , 1 | 2 ; 3 nothing
    names = np.zeros(len(kind), np.int64)
    names[to_a], names[to_b] = ids_a, ids_b
    kind[to_a[last_a]], kind[to_b[last_b]] = 1, 2
    kind[to_b[bounds_b[1:] - 1]] = 3
    made = tools.names.take(pa.array(kind * tools.stride + names))
    _, offsets, data = made.buffers()
    cuts = (np.frombuffer(offsets, np.int64)[: len(made) + 1] if len(made) else np.zeros(1, np.int64))[bounds_a + bounds_b]
    digests = [""] * len(texts)
    for i, start, end in zip(kept.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        digests[i] = hashlib.sha256(memoryview(data)[start:end]).hexdigest()

    lists = np.concatenate([[0], np.cumsum(per_text(counts_of(counted.column("doc"))))]).astype(np.int32)
    return {
        "n_a": per_text(np.diff(bounds_a)), "n_b": per_text(np.diff(bounds_b)), "n_groups": per_text(counts_of(shared.column("doc"))),
        "n_links": per_text(counts_of(links.column("doc"))), "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(lists, counted.column("pair").combine_chunks()),
        "times": pa.ListArray.from_arrays(lists, counted.column("count_all").combine_chunks()),
    }


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_BYTES of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _aligned(options: AlignOptions) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            tools = tokenizers(options)
            for batch in batches:
                for part in _slices(batch):
                    found = align_texts(part.column("text").to_pylist(), tools)
                    columns = {"row": part.column("row"), "doc_id": part.column("doc_id"), **found}
                    yield pa.RecordBatch.from_pydict({name: c if isinstance(c, pa.Array) else pa.array(c) for name, c in columns.items()})
        finally:
            give_back_memory()

    return run


def _partial_counts(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the task's pairs so far; when their number outgrows `held` rows they are handed on."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        made = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"pair": made.column("pair"), "n": made.column("n_sum")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = least = 0
        for batch in batches:
            flat = [batch.column(c).flatten() for c in ("pairs", "times")]
            waiting.append(pa.table(flat, names=["pair", "n"]))
            rows += len(flat[0])
            if rows > held + 2 * least:
                waiting = [summed(waiting)]
                rows = least = len(waiting[0])
                if rows > held:
                    yield from waiting.pop().to_batches(max_chunksize=50_000)
                    rows = least = 0
        if waiting:
            yield from summed(waiting).to_batches(max_chunksize=50_000)
        give_back_memory()

    return run


def align(docs: DataFrame, options: AlignOptions) -> Alignment:
    """Align all texts of `docs` and count the linked id pairs over all of them.

    A text that is null or empty, or that either tokenizer does not spell out byte by byte, has no tokens. Every
    row is a text of its own, repeated or not, whatever its id. A text of any length is worked on whole by one
    task; short ones in slices of bounded size. Only doc_id and text are read, whatever other columns there are.
    An empty table gives empty tables.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = staged(rows.mapInArrow(_aligned(options), ALIGNED_SCHEMA), "align-texts")
    partial = texts.select("pairs", "times").mapInArrow(_partial_counts(options.partial_rows), "pair bigint, n bigint")
    counts = staged(partial.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    second = F.shiftright("pair", 32).alias("second")
    # At most one row for each id of the second vocabulary.
    most = staged(counts.groupBy(second).agg(F.max("n").alias("most")), "align-most")
    best = counts.select("*", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return Alignment(texts, staged(best, "align-best"))


def _looked_up(known: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the pairs that are known here; the other pairs of a text stay in its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            own = batch.column("pairs")
            parents = pc.list_parent_indices(own).to_numpy()
            coded = own.flatten().dictionary_encode()
            times = batch.column("times").flatten().to_numpy()
            distinct = coded.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(pairs, distinct), max(len(pairs) - 1, 0))
            hit = pairs[at] == distinct if len(pairs) else np.zeros(len(distinct), bool)
            code = coded.indices.to_numpy()
            n = np.where(hit, counts[at], 0)[code] if len(pairs) else np.zeros(len(code), np.int64)
            top = np.where(hit & best[at], 1, 0)[code] if len(pairs) else np.zeros(len(code), np.int64)
            sums = []
            for values in (top, n):
                total = np.concatenate([[0], np.cumsum(values * times)])
                ends = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=batch.num_rows))])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            left = ~hit[code]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[left], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[left])) for v in (distinct[code], times)]
            kept = [batch.column(c) for c in _KEPT]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *rest], names=[*_KEPT, "n_best", "count_sum", "pairs", "times"])
        give_back_memory()

    return run


_KEPT = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def link_statistics(alignment: Alignment, options: AlignOptions) -> DataFrame:
    """Every text with n_best (its links whose pair is the most frequent of the second id) and count_sum (over its links)."""
    counts = alignment.counts
    # Frequent pairs: the largest power of two classes of counts that together stay within the bound.
    bits = F.length(F.bin("n"))
    sizes = {r.bits: r["count"] for r in counts.groupBy(bits.alias("bits")).count().collect()}
    least, total = 64, 0
    for size in range(63, 0, -1):
        total += sizes.get(size, 0)
        if total > options.known_pairs:
            break
        least = size
    held = counts.where(bits >= least).toArrow().sort_by("pair")
    arrays = tuple(held.column(c).to_numpy() for c in ("pair", "n", "best"))
    known = counts.sparkSession.sparkContext.broadcast(arrays)
    schema = ALIGNED_SCHEMA.replace("pairs array", "n_best bigint, count_sum bigint, pairs array")
    found = staged(alignment.texts.mapInArrow(_looked_up(known), schema), "align-found")
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    rest = found.where(F.size("pairs") > 0).select("row", zipped).select("row", "x.pairs", "x.times")
    rare = counts.where(bits < least).select(F.col("pair").alias("pairs"), "n", F.col("best").cast("bigint").alias("top"))
    sums = rest.join(rare, "pairs").groupBy("row").agg(
        F.sum(F.col("top") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    whole = found.select(*_KEPT, "n_best", "count_sum").join(staged(sums, "align-rest"), "row", "left")
    return whole.select(
        *_KEPT[1:],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
