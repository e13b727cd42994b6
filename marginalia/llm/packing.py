"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the context
length as fit, then the binary digits of the rest, from the largest to the smallest. Each piece is a
sequence of its own, so no sequence crosses documents and nothing is padded; sequences of equal
length form a bucket (its logarithm), from which a trainer draws its batches.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_batches, texts_of

_CONTROL = "\x1c\x1d\x1e\x1f"
#: Letters that are lower-cased one by one; with ASCII they make up the chunks that the fast path takes.
_LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and c != "İ")
_PLAIN = {*map(chr, range(0x80)), *_LETTERS}
#: Where the tokenizer cuts words, as words of letters are what lies between: suffixes, single digits, other marks.
_CUTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9 \n{_LETTERS.lower()}]+")
_ENCODERS: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _word_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """Token bytes -> id, with a space for the mark that ends a word.

    Ids ascend in order of the merges, so they are ranks, and the ends of words come first. An encoder that
    merges by rank gives the tokenizer's ids for every word if the merges rebuild every token from its own
    bytes: whichever pair makes up a token's bytes when its rank has come is then the pair that its merge names.
    """
    letters = {letter: byte for byte, letter in _byte_letters().items()}
    ranks = {}
    for token, rank in vocabulary.items():
        if token not in special:
            core = token.removesuffix("</w>")
            ranks[bytes(map(letters.__getitem__, core)) + (b" " if len(core) < len(token) else b"")] = rank
    return ranks


class ChunkEncoder:
    """Texts -> little-endian uint32 ids, as the tokenizer gives them.

    This vocabulary drops white space and never merges across it, so a text's ids are those of the chunks between
    white space. Many texts are split at once; their distinct chunks are merged in one call, each ending in a line
    feed, whose id tells them apart again; then every text gathers the ids of its chunks. Chunks of other
    letters and special tokens take the tokenizer's whole path, and so do texts that it normalises.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = _word_ranks(self.tokenizer.get_vocab(with_added_tokens=False), special)
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.line_feed = ranks[b"\n "]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def chunk_ids(self, chunks: list[str]) -> pa.LargeListArray:
        """The ids of each of `chunks`, which hold no white space."""
        joined = " \n ".join(chunks)
        odd = []
        if "<|" in joined or not _PLAIN.issuperset(joined):
            odd = [i for i, c in enumerate(chunks) if "<|" in c or not _PLAIN.issuperset(c)]
            others = dict.fromkeys(odd, "")
            joined = " \n ".join(others.get(i, c) for i, c in enumerate(chunks))
        ids = self.merges.encode_to_numpy(_CUTS.sub(r" \g<0> ", joined.lower()) + " \n ")
        ends = np.flatnonzero(ids == self.line_feed)
        counts = np.diff(ends, prepend=-1) - 1
        flat = ids[ids != self.line_feed].astype("<u4")
        if odd:
            made = [self.whole(chunks[i]) for i in odd]
            at = (np.cumsum(counts) - counts)[odd]
            flat = np.insert(flat, np.repeat(at, [len(m) for m in made]), np.concatenate(made))
            counts[odd] = [len(m) for m in made]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(flat))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        odd = [any(c in text for c in _CONTROL) or not unicodedata.is_normalized("NFC", text) for text in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        gathered = self.chunk_ids(chunks.dictionary.to_pylist()).take(chunks.indices)
        bounds = gathered.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        ids = gathered.flatten().to_numpy().astype("<u4")
        for o, text, start, end in zip(odd, texts, bounds[:-1], bounds[1:], strict=True):
            yield (self.whole(text) if o else ids[start:end]).tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str) -> ChunkEncoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces_of(n: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens; `context` is a power of two."""
    pieces = [(start, context) for start in range(0, n - n % context, context)]
    at, size = n - n % context, context >> 1
    while at < n:
        if n - at >= size:
            pieces.append((at, size))
            at += size
        size >>= 1
    return pieces


SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, bucket int, ids binary"
)


def power_of_two_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, context: int = 4096, with_ids: bool = True) -> DataFrame:
    """The pieces of every document with their ids (little-endian uint32); each is one sequence.

    A null or empty text is the end id alone; an empty table has no pieces. Rows are independent: repeated
    rows give repeated pieces with sequences of their own. A text of any length is cut whole, within its
    own row. Only doc_id and text are read, so further columns of any name do not matter. `sequence_id`
    is unique and ascends within an input split. Without `with_ids` the ids stay in the task.
    """
    if context & (context - 1):
        raise ValueError("the context must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    schema = SCHEMA if with_ids else SCHEMA.removesuffix(", ids binary")
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list[Any]] = [[] for _ in range(7)]
        encoded = encoder(vocabulary).encode_all(batch.column("text").to_pylist())
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            ids += end
            n = len(ids) // 4
            for start, length in pieces_of(n, context):
                piece = ids[4 * start : 4 * (start + length)]
                row = (doc_id, start, length, zlib.crc32(piece), n, length.bit_length() - 1, piece)
                for column, cell in zip(columns, row, strict=True):
                    column.append(cell)
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        arrays.insert(5, pa.array(np.zeros(len(columns[0]), np.int64)))
        return pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    return map_batches(texts_of(docs), work, schema).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with one folder per bucket of equal lengths; no shuffle is needed."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
