"""Token pooling, normalisation, and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, IntegralType, StructField, StructType

from marginalia.functions import vectors as V

MASK_FLOOR = 1e-9  # fixed value: smallest divisor of a masked mean
BATCH_TEXTS = 16
MAX_TOKENS = 512
#: Texts that are sorted by length together.
POOL_TEXTS = 1024
HASH_DIM = 64
#: Texts whose words are told apart together, and different words that are Python objects at a time.
HASH_TEXTS = 2048
HASH_WORDS = 65536

Encoder = Callable[[list[str]], "object"]


def l2_normalize(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Scale `vec` to unit length (DOUBLE); an all-zero vector stays all zero."""
    return vectors.withColumn(vec, V.unit(F.col(vec)))


def _combined(rows: DataFrame) -> DataFrame:
    """(key, total, weight) with the rows of one key in an Arrow batch added up.

    Rows of a key mostly lie together, and an aggregate of vectors would sort all rows as soon as it holds more
    than a few keys. A batch with nulls or unequal widths stays as it is, as does one whose keys Arrow cannot compare.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, total, weight = batch.columns
            flat = total.flatten()
            widths = np.diff(total.offsets.to_numpy())
            if not batch.num_rows or total.null_count or flat.null_count or weight.null_count or widths.min() != widths.max():
                yield batch
                continue
            try:
                codes = keys.dictionary_encode("encode").indices.to_numpy()
            except pa.ArrowNotImplementedError:
                yield batch
                continue
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat(flat.to_numpy().reshape(len(codes), -1)[order], starts, axis=0)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * sums.shape[1])
            columns = [
                keys.take(pa.array(order[starts])),
                pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())),
                pa.array(np.add.reduceat(weight.to_numpy()[order], starts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(combine, rows.schema)


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(key, pos, vec, mask) to (key, vec): mean of the token vectors with mask 1.

    The element-wise sum is a combining aggregate, so a key with very many tokens is reduced in
    every partition before the shuffle; tokens that lie together are added up before that. All tokens masked gives zeros.
    """
    weighted = F.transform(V.as_double(F.col("vec")), lambda x: x * F.col("mask"))
    whole = isinstance(tokens.schema["mask"].dataType, IntegralType)
    weight = F.col("mask").cast("bigint" if whole else "double")
    sums = _combined(tokens.select("key", weighted.alias("total"), weight.alias("weight"))).groupBy("key").agg(
        Summarizer.sum(array_to_vector("total")).alias("total"),
        F.sum("weight").alias("weight"),
    )
    divisor = F.greatest(F.col("weight").cast("double"), F.lit(MASK_FLOOR))
    return sums.select("key", F.transform(vector_to_array("total"), lambda x: x / divisor).alias("vec"))


def first_token_pool(tokens: DataFrame) -> DataFrame:
    """(key, vec) of token 0."""
    return tokens.where(F.col("pos") == 0).select("key", V.as_double(F.col("vec")).alias("vec"))


def check_dims(new: DataFrame, mine: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: smallest and largest vector width on both sides, and whether all agree."""
    sides = new.select(F.size(vec).alias("new"), F.lit(None).cast("int").alias("mine")).unionAll(
        mine.select(F.lit(None).cast("int"), F.size(vec))
    )
    widths = sides.agg(
        F.min("new").alias("new_min"), F.max("new").alias("new_max"),
        F.min("mine").alias("mine_min"), F.max("mine").alias("mine_max"),
    )
    one = (F.col("new_min") == F.col("new_max")) & (F.col("mine_min") == F.col("mine_max"))
    return widths.withColumn("agree", one & (F.col("new_min") == F.col("mine_min")))


def require_dims(new: DataFrame, mine: DataFrame, vec: str = "vec") -> None:
    """Raise unless all vectors of both sides have one width. Runs a job."""
    widths = check_dims(new, mine, vec).first()
    if widths.agree is False:
        raise ValueError(f"vector widths differ: {widths.asDict()}")


#: Encoders of this Python worker by their id; a new id takes the place of the old one.
LOADED: dict[str, Encoder] = {}


def embed(
    texts: DataFrame, encoder_factory: Callable[[], Encoder], batch_size: int = BATCH_TEXTS, encoder_id: str | None = None
) -> DataFrame:
    """Put `vec`, scaled to unit length, in place of `text`; other columns pass through.

    `encoder_factory` runs on the executor, once per task, or once per Python worker if `encoder_id` says
    which encoder it is, and returns a function from a list of
    texts to a matrix with one row per text. The encoder gets whole texts, `batch_size` at a
    time; truncation, if its model needs it, is its own affair.
    """
    kept = texts.drop("text")
    names = kept.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        encoder = None
        for batch in batches:
            if encoder is None and encoder_id is not None:
                from marginalia.operators import vectors as worker

                if encoder_id not in worker.LOADED:
                    worker.LOADED.clear()
                    worker.LOADED[encoder_id] = encoder_factory()
                encoder = worker.LOADED[encoder_id]
            encoder = encoder or encoder_factory()
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                matrix = np.asarray(encoder(part.column("text").to_pylist()), dtype=np.float64)
                lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = matrix / np.maximum(lengths, 1e-12)
                offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
                vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), vec], names=[*names, "vec"])

    return texts.mapInArrow(encode, StructType([*kept.schema.fields, StructField("vec", ArrayType(DoubleType()))]))


#: From a list of texts to their token ids; from a padded matrix of ids and its mask to a matrix of vectors.
Tokenize = Callable[[list[str]], "list[list[int]]"]
Forward = Callable[["object", "object"], "object"]


def embed_padded(
    texts: DataFrame,
    model_factory: Callable[[], tuple[Tokenize, Forward]],
    max_tokens: int = MAX_TOKENS,
    batch_size: int = BATCH_TEXTS,
    pool_texts: int = POOL_TEXTS,
    encoder_id: str | None = None,
) -> DataFrame:
    """Put `vec`, scaled to unit length, `n_tokens` and `n_padded` in place of `text`; other columns pass through.

    For encoders that pad: texts are cut to `max_tokens` tokens, and of every `pool_texts` of a partition those
    of like length share a batch, which is padded to its own longest text only. Rows come out in the order
    in which they came in. `n_tokens` counts the tokens used and `n_padded` the length of the batch. `model_factory`
    runs on the executor, as for `embed`, and returns the tokenizer and the forward pass, which must not let
    masked places matter. A text without tokens is one padded place.
    """
    kept = texts.drop("text")
    names = kept.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        model = None
        for whole in batches:
            if model is None and encoder_id is not None:
                from marginalia.operators import vectors as worker

                if encoder_id not in worker.LOADED:
                    worker.LOADED.clear()
                    worker.LOADED[encoder_id] = model_factory()
                model = worker.LOADED[encoder_id]
            tokenize, forward = model = model or model_factory()
            for at in range(0, whole.num_rows, pool_texts):
                pool = whole.slice(at, pool_texts)
                ids = [row[:max_tokens] for row in tokenize(pool.column("text").to_pylist())]
                sizes = np.array([len(row) for row in ids], dtype=np.int32)
                by_length = np.argsort(sizes, kind="stable")
                padded, vectors = np.zeros(len(ids), dtype=np.int32), [None] * len(ids)
                for start in range(0, len(ids), batch_size):
                    places = by_length[start : start + batch_size]
                    width = max(1, int(sizes[places[-1]]))
                    matrix = np.zeros((len(places), width), dtype=np.int64)
                    mask = np.arange(width) < sizes[places][:, None]
                    matrix[mask] = [token for place in places for token in ids[place]]
                    made = np.asarray(forward(matrix, mask.astype(np.int64)), dtype=np.float64)
                    made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                    padded[places] = width
                    for place, vector in zip(places.tolist(), made, strict=True):
                        vectors[place] = vector
                vec = pa.array(vectors, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*(pool.column(c) for c in names), vec, pa.array(sizes), pa.array(padded)], names=[*names, "vec", "n_tokens", "n_padded"]
                )

    more = [StructField("vec", ArrayType(DoubleType())), StructField("n_tokens", IntegerType()), StructField("n_padded", IntegerType())]
    return texts.mapInArrow(encode, StructType([*kept.schema.fields, *more]))


def hashing_vectors(texts: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Put `vec` in place of `text` with a model-free encoder.

    Every word falls into one of `dim` buckets by the first 32 bits of its MD5; the vector is the bucket counts,
    scaled to unit length. Row-local: no shuffle. Most of the time goes into digests, so of up to `HASH_TEXTS`
    texts that share an Arrow batch each different word is hashed once.
    """
    kept = texts.drop("text")
    names = kept.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def buckets(words: pa.Array) -> Iterator[int]:
            for at in range(0, len(words), HASH_WORDS):
                for word in words.slice(at, HASH_WORDS).cast(pa.binary()).to_pylist():
                    yield int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big") % dim

        for batch in batches:
            if batch.column("text").null_count:
                raise ValueError("a text is NULL")
            for start in range(0, batch.num_rows, HASH_TEXTS):
                part = batch.slice(start, HASH_TEXTS)
                split = pc.utf8_split_whitespace(part.column("text"))  # where `S.words` does
                words = split.flatten().dictionary_encode()
                places, distinct = words.indices.to_numpy(), words.dictionary
                bucket = np.fromiter(buckets(distinct), np.int64, len(distinct))
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(split).to_numpy())
                there = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[places]  # whitespace at an end leaves an empty word
                cells = (rows * dim + bucket[places])[there]
                matrix = np.bincount(cells, minlength=part.num_rows * dim).reshape(-1, dim).astype(np.float64)
                matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), V.NORM_FLOOR)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * dim
                vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), vec], names=[*names, "vec"])

    # Spark's lower case, as it is that of every other operator.
    lowered = texts.withColumn("text", F.lower("text"))
    return lowered.mapInArrow(encode, StructType([*kept.schema.fields, StructField("vec", ArrayType(DoubleType()))]))
