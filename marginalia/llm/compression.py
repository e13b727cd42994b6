"""Quality classifier by compression: which of two dictionaries makes a text shorter.

One zstandard dictionary is built from good and one from bad labelled text. A text is compressed with
each; the difference of the sizes, normalised by the size without a dictionary, is the evidence. A
logistic regression on rows that built no dictionary turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fit_logistic, labelled_ids, logistic, map_batches, texts_of


@dataclass(frozen=True)
class CompressionOptions:
    """Bounds of the fit; none of them touches which rows are scored or how."""

    per_class: int = 4000  # labelled documents of each class that are read at most
    pieces_per_class: int = 6000  # pieces of text that each dictionary is trained on at most
    piece_chars: int = 600
    dictionary_bytes: int = 64 << 10
    level: int = 3
    modulus: int = 4
    held_out: int = 2


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, ...]


_OPEN: dict[int, tuple[Any, ...]] = {}


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw pieces where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes() if pieces else b""
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressors(model: CompressionModel) -> tuple[Any, ...]:
    key = hash((model.good, model.bad, model.level))
    if key not in _OPEN:
        made = []
        for raw in (model.good, model.bad):
            data = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
            if data is not None:
                data.precompute_compress(level=model.level)
            made.append(zstandard.ZstdCompressor(level=model.level, dict_data=data, write_content_size=False))
        made.append(zstandard.ZstdCompressor(level=model.level, write_content_size=False))
        _OPEN.clear()
        _OPEN[key] = tuple(made)
    return _OPEN[key]


def evidence(texts: list[bytes], model: CompressionModel) -> np.ndarray:
    """Per text: the normalised difference of sizes, both ratios, and the logarithm of the length."""
    good, bad, plain = _compressors(model)
    out = np.zeros((len(texts), 6))
    for i, text in enumerate(texts):
        if text:
            a, b, c = len(good.compress(text)), len(bad.compress(text)), len(plain.compress(text))
            n = len(text)
            out[i] = (b - a) / c, (b - a) / (a + b), a / n, c / n, np.log1p(n), (b - a) / np.sqrt(n)
        else:
            out[i] = 0.0, 0.0, 1.0, 1.0, 0.0, 0.0
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    """The evidence with squares and products: a smooth calibration surface."""
    scale = x / np.array([0.2, 0.1, 0.5, 0.5, 8.0, 3.0])
    pairs = [scale[:, [i]] * scale[:, [j]] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.hstack([scale, *pairs])


def fit(docs: DataFrame, labels: DataFrame, options: CompressionOptions = CompressionOptions()) -> CompressionModel:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    Even ids of a hash build the dictionaries, odd ones calibrate, so that no text calibrates what it
    built. Pieces are spread over whole texts. At most 2 x `pieces_per_class` pieces and
    2 x `per_class` rows of numbers reach the driver. Without labels of both classes the score is
    constant at the share of good labels (0.5 without any).
    """
    ids = labelled_ids(labels, "quality", options.modulus, options.held_out, options.per_class)
    chosen = texts_of(docs).join(F.broadcast(ids), "doc_id").withColumn("part", F.abs(F.xxhash64("doc_id", F.lit("part"))) % 2)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(options.piece_chars))
    cut = (
        chosen.where("part = 0 AND length(text) > 0")
        .select("doc_id", "label", "text", F.explode(starts).alias("at"))
        .select("label", F.xxhash64("doc_id", "at").alias("h"), F.expr(f"substring(text, at + 1, {options.piece_chars})").alias("piece"))
    )
    sides = {}
    for side in (0, 1):
        rows = cut.where(F.col("label") == side).orderBy("h", "piece").limit(options.pieces_per_class).select("piece").collect()
        sides[side] = _dictionary([r.piece.encode() for r in rows], options.dictionary_bytes)
    blank = CompressionModel(sides[1], sides[0], options.level, ())
    rows = evidence_of(chosen.where("part = 1").select("label", "weight", "text"), blank).collect()
    x, y = np.array([r.evidence for r in rows]).reshape(-1, 6), np.array([r.label for r in rows], dtype=float)
    counts = np.array([r.weight for r in rows])
    if len(set(y)) < 2:
        weights = np.zeros(_expanded(np.zeros((1, 6))).shape[1] + 1)
        weights[-1] = np.log((counts @ y + 0.5) / (counts @ (1 - y) + 0.5)) if len(y) else 0.0
    else:
        weights = fit_logistic(_expanded(x), y, ridge=1e-5, counts=counts)
    return CompressionModel(sides[1], sides[0], options.level, tuple(weights))


def evidence_of(rows: DataFrame, model: CompressionModel) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = evidence(batch.column("text").cast(pa.binary()).to_pylist(), model)
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("weight"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["label", "weight", "evidence"]
        )

    return map_batches(rows, work, "label int, weight double, evidence array<double>")


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score, difference) for every row of `docs`; a null text is an empty one.

    The model is bounded by the sizes of two dictionaries and travels with the task. Rows are
    independent; nothing is shuffled.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = evidence(batch.column("text").cast(pa.binary()).to_pylist(), model)
        value = logistic(_expanded(found), np.array(model.weights))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(found[:, 0])], names=["doc_id", "score", "difference"])

    return map_batches(texts_of(docs), work, "doc_id bigint, score double, difference double")


def accepted_rows(docs: DataFrame, model: CompressionModel, least: float) -> DataFrame:
    """The rows of `docs` that score `least` or more, all columns as they are; each row is scored where it lies.

    A null text is scored as an empty one and stays null. A table of any columns will do, also one named
    `score`; an empty one stays empty.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        value = logistic(_expanded(evidence(texts, model)), np.array(model.weights))
        return batch.filter(pa.array(value >= least))

    return map_batches(docs, work, docs.schema)
