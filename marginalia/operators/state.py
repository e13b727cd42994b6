"""Change detection: row hashes, corpus fingerprints, rebuild decisions, incremental vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.text import compose_text
from marginalia.options import ModelOptions
from marginalia.session import staged


def with_hash(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("content_hash", F.md5("content"))


def changed_rows(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, content) twice to (key, change): new, changed, unchanged or removed.

    Texts are hashed where they lie; only keys and hashes are shuffled.
    """
    old = previous.select("key", F.md5("content").alias("old"))
    now = current.select("key", F.md5("content").alias("now"))
    change = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("old") == F.col("now"), "unchanged")
        .otherwise("changed")
    )
    return old.join(now, "key", "full_outer").select("key", change.alias("change"))


def changed_rows_localised(previous: DataFrame, current: DataFrame, bucket_rows: int = 16) -> DataFrame:
    """`changed_rows` for corpora of which little has changed: only buckets that differ are joined.

    Rows fall into buckets of about `bucket_rows` by their key, and a bucket's digest is its number of rows and
    the sums of their hashes, which combine before the shuffle. A row in a bucket with equal digests on both sides is
    unchanged and stays where it is. Rows without a key never match and are told one by one, as there.
    """
    old = previous.select("key", F.md5("content").alias("old"))
    now = current.select("key", F.md5("content").alias("now"))
    buckets = max(1, now.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    # Hashes are written once; both levels read them.
    old, now = staged(old.select("*", bucket), "old-hashes"), staged(now.select("*", bucket), "new-hashes")

    def digests(rows: DataFrame, name: str) -> DataFrame:
        place = F.xxhash64("key", name)
        sums = [F.sum(F.shiftright(place, 32)).alias("high"), F.sum(place.bitwiseAND(0xFFFFFFFF)).alias("low")]
        return rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.count("key").alias("keyed"), *sums)

    sides = digests(old, "old"), digests(now, "now")
    facts = ["rows", "keyed", "high", "low"]
    same = sides[0].join(sides[1], ["bucket", *facts]).where(F.col("rows") == F.col("keyed")).select("bucket")
    same = staged(same, "equal-buckets")
    left, right = (side.join(same, "bucket", "left_anti").drop("bucket") for side in (old, now))
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("old") == F.col("now"), "unchanged").otherwise("changed")
    )
    joined = left.join(right, "key", "full_outer").select("key", change.alias("change"))
    # A text that is null on both sides counts as new, as in the join.
    stayed = F.when(F.col("now").isNull(), "new").otherwise("unchanged").alias("change")
    return joined.unionByName(now.join(same, "bucket", "left_semi").select("key", stayed))


def corpus_fingerprint(corpus: DataFrame, by: str = "corpus_id") -> DataFrame:
    """(by, content_hash): one hash of the multiset of contents, blind to order and keys.

    The four 32-bit words of each row's MD5 are summed, so that a corpus of any size is a handful
    of running sums that combine before the shuffle.
    """
    digest = F.md5("content")
    sums = [
        F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_s{i}")
        for i in range(4)
    ]
    totals = corpus.groupBy(by).agg(F.count(F.lit(1)).cast("string").alias("_n"), *sums)
    parts = ["_n", "_s0", "_s1", "_s2", "_s3"]
    return totals.select(by, F.md5(F.concat_ws("|", *parts)).alias("content_hash"))


def model_fingerprint(options: ModelOptions) -> str:
    return f"{options.model}|adapters={options.adapters}|base={options.base}|adapter={options.adapter}"


def with_model_fingerprint(vectors: DataFrame, options: ModelOptions) -> DataFrame:
    return vectors.withColumn("fingerprint", F.lit(model_fingerprint(options)))


def stale_vectors(vectors: DataFrame, options: ModelOptions) -> DataFrame:
    """Vectors made by another model. A vector without a fingerprint is not stale."""
    return vectors.where(F.col("fingerprint") != F.lit(model_fingerprint(options)))


def rebuild_decision(
    current: DataFrame, state: DataFrame, stored: DataFrame, fingerprint: str, check: bool = True
) -> DataFrame:
    """(corpus_id, rebuild) for every corpus of `current` (corpus_id, content_hash).

    `state` has the last (corpus_id, content_hash, fingerprint) and `stored` the corpus_id of every
    corpus with vectors. A corpus is rebuilt when checking is on and it has no old hash, another
    hash, no vectors, or vectors of another model; a missing fingerprint is no reason.
    """
    old = state.select("corpus_id", F.col("content_hash").alias("_hash"), F.col("fingerprint").alias("_model"))
    present = stored.select("corpus_id").distinct().withColumn("_stored", F.lit(True))
    facts = current.join(old, "corpus_id", "left").join(present, "corpus_id", "left")
    reasons: Column = (
        F.col("_hash").isNull()
        | (F.col("_hash") != F.col("content_hash"))
        | F.col("_stored").isNull()
        | F.coalesce(F.col("_model") != F.lit(fingerprint), F.lit(False))
    )
    return facts.select("corpus_id", (F.lit(check) & reasons).alias("rebuild"))


def incremental_vectors(
    corpus: DataFrame,
    vectors: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    fingerprint: str,
    stage: bool = True,
) -> DataFrame:
    """Vectors of `corpus` with as little encoding as possible.

    `corpus` is (key, content), `vectors` the stored (key, vec, content_hash, fingerprint). Rows
    that are new, changed or made by another model go through `encode`; the others are taken over;
    removed ones disappear. The result equals encoding everything.

    What to encode and what to drop is decided on keys and hashes alone. With `stage` these two
    small tables are written first, and texts and vectors need no shuffle when little has changed.
    """
    hashed = with_hash(corpus)
    digests = hashed.select("key", "content_hash")
    if stage:
        digests = staged(digests, "content-hashes")  # the wide corpus is read for hashing once
    # As for `stale_vectors`, a missing fingerprint does not tell of another model.
    valid = vectors.where(F.coalesce("fingerprint", F.lit(fingerprint)) == F.lit(fingerprint))
    valid = valid.withColumn("fingerprint", F.lit(fingerprint))
    on = ["key", "content_hash"]
    to_encode = digests.join(valid.select(*on), on, "left_anti")
    to_drop = valid.select(*on).join(digests, on, "left_anti")
    if stage:
        to_encode, to_drop = staged(to_encode, "to-encode"), staged(to_drop, "to-drop")
    kept = valid.join(to_drop, on, "left_anti")
    fresh = encode(compose_text(hashed.join(to_encode, on, "left_semi")))
    columns = ["key", "vec", "content_hash", "fingerprint"]
    return kept.select(*columns).unionByName(fresh.withColumn("fingerprint", F.lit(fingerprint)).select(*columns))
