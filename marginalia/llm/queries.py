"""One query per operator of this package over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import alignment, compression, dart, decision_list, language, licenses, manifest, maxscore, mixing, packing, secret_scan, subspace, toxicity
from marginalia.llm.common import id_fold, labelled_ids, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "lang", "confidence", "text_lang", "declared", "host")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    options = toxicity.ToxicOptions()
    scored = toxicity.score(docs, toxicity.fit(docs, labels, options), options)
    return scored.select(
        "doc_id",
        (id_fold(options.modulus) == options.held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    options = compression.CompressionOptions()
    scored = compression.score(docs, compression.fit(docs, labels, options))
    return scored.select(
        "doc_id",
        (id_fold(options.modulus) == options.held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "n_cells")


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    options = decision_list.ListOptions()
    ids = labelled_ids(labels, "quality", 1, -1, options.per_class)
    ruled = decision_list.quality_rules(docs, ids, options)
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_decoded", "layers"
    )


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.power_of_two_pieces(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op11_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = manifest.build_manifest(table(spark, sf_dir, "documents"), manifest.without_line_feeds())
    return manifest.prove(built).drop("siblings")


def op12_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = alignment.AlignOptions(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return alignment.link_statistics(alignment.align(table(spark, sf_dir, "documents"), options), options)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_fusion,
        op2_license_scan,
        op3_kneser_ney_toxicity,
        op4_water_filling_mix,
        op5_compression_quality,
        op6_subspace_pigeonhole,
        op7_dart_minhash,
        op8_decision_list,
        op9_secret_scan,
        op10_power_of_two_packing,
        op11_postorder_manifest,
        op12_maxscore_search,
        op13_arrow_alignment,
    )
}

OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents
), ranked AS (
  SELECT source, sum(size) AS s, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM base GROUP BY source
), levels AS (
  SELECT *, 2.0 * s::DOUBLE AS cap, 2.0 * s::DOUBLE / w AS ratio FROM ranked
), steps AS (
  SELECT *, (1.5 * (SELECT sum(s)::DOUBLE FROM ranked)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels
), goals AS (
  SELECT source, s::BIGINT AS source_size,
         least(cap, w * coalesce((SELECT level FROM steps WHERE level < ratio ORDER BY ratio LIMIT 1), 'infinity'::DOUBLE)) AS target
  FROM steps
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole FROM goals
), placed AS (
  SELECT b.*, g.source_size, g.target, g.whole, floor(g.target + 0.5)::BIGINT - g.whole * g.source_size AS extra,
         sum(size) OVER (PARTITION BY b.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM base b JOIN wholes g ON b.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + least(size, greatest(0, extra - start)))::BIGINT AS taken
FROM placed
"""

_DIGEST = """sha256(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-')
    || coalesce(octet_length(encode({text})) || ':' || {text}, '-'))"""
_PARENT = """sha256(CASE WHEN w.idx % 3 = 0 THEN w.folded ELSE r.a END || CASE WHEN w.idx % 3 = 1 THEN w.folded ELSE coalesce(r.b, '') END
    || CASE WHEN w.idx % 3 = 2 THEN w.folded ELSE coalesce(r.c, '') END)"""
_SIBLINGS = """CASE WHEN w.idx % 3 = 0 THEN '' ELSE r.a END || CASE WHEN w.idx % 3 = 1 THEN '' ELSE coalesce(r.b, '') END
    || CASE WHEN w.idx % 3 = 2 THEN '' ELSE coalesce(r.c, '') END"""
_RUN = "max(CASE WHEN idx % 3 = 0 THEN d END) AS a, max(CASE WHEN idx % 3 = 1 THEN d END) AS b, max(CASE WHEN idx % 3 = 2 THEN d END) AS c"

OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), base AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS key, {_DIGEST.format(text="text")} AS leaf,
         {_DIGEST.format(text="replace(text, chr(10), '')")} AS bad,
         list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) AS crc
  FROM documents, crc
), leaves AS (
  SELECT *, CASE WHEN xor(coalesce(crc, 4294967295), 4294967295) % 2 = 0 THEN bad ELSE leaf END AS suspect,
         row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n
  FROM base
), nodes AS (
  SELECT key, source, 0 AS lvl, idx, n, leaf AS d FROM leaves
  UNION ALL
  SELECT key, source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY key, source, lvl, n, idx // 3
), subroots AS (
  SELECT key, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, idx, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lvl, n, idx // 3
), runs AS (
  SELECT key, lvl, idx // 3 AS run, {_RUN} FROM nodes WHERE n > 1 GROUP BY key, lvl, idx // 3
), crown_runs AS (
  SELECT lvl, idx // 3 AS run, {_RUN} FROM crown WHERE n > 1 GROUP BY lvl, idx // 3
), walk AS (
  SELECT doc_id, key, leaf, 0 AS lvl, idx, n, suspect AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.key, w.leaf, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, {_PARENT}, w.proof || {_SIBLINGS}
  FROM walk w JOIN runs r ON w.key = r.key AND w.lvl = r.lvl AND w.idx // 3 = r.run WHERE w.n > 1
), climb AS (
  SELECT doc_id, leaf, s.d AS subroot, 0 AS lvl, s.idx, s.n, folded, proof FROM walk w JOIN subroots s ON w.key = s.key WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, {_PARENT}, w.proof || {_SIBLINGS}
  FROM climb w JOIN crown_runs r ON w.lvl = r.lvl AND w.idx // 3 = r.run WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb, (SELECT d AS root FROM crown WHERE n = 1) WHERE n = 1
"""

OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op4_water_filling_mix": OP4_SQL,
    "op11_postorder_manifest": OP11_SQL,
    "op12_maxscore_search": OP12_SQL,
}
