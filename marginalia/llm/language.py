"""Language identification of pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: character trigrams of the page's text, the language its
markup declares, the suffix of its address (top-level domain and a leading language segment of the
path), and the prior of its host. Text models are learned from labelled documents. The other tables are
sums of the text posteriors, by grouped aggregation: a host's prior is smoothed towards that of its
registered domain, and this towards that of all pages, each without the page's own contribution.
"""

from __future__ import annotations

import html as markup
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_batches, mix64
from marginalia.session import staged

DROPPED = re.compile(r"<!--.*?-->|<(script|style|nav|aside|footer|noscript)\b[^>]*>.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
MAIN = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.DOTALL | re.IGNORECASE)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)
ADDRESS = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?(?:/([A-Za-z]{2})(?=[/?#-]|$))?")


@dataclass(frozen=True)
class LanguageOptions:
    sample: int = 6000  # labelled documents of each language that its text model is learned from, about
    buckets: int = 1 << 15
    smoothing: float = 0.5  # added to each trigram count
    evidence: float = 40.0  # trigrams depend on each other; their sum counts as at most so many independent ones
    strength: float = 8.0  # pages that a parent's prior counts as in its child's
    table_smoothing: float = 2.0  # pages that the general share of a declared language or suffix counts as


def trigram_buckets(text: str, buckets: int) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased letters, other characters being one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = ((code >= 97) & (code <= 122)) | (code >= 192)
    code = np.where(letter, code, np.uint64(32))
    code = code[letter | np.concatenate([[True], letter[:-1]])] if len(code) else code
    if len(code) < 3:
        return np.zeros(0, np.int64)
    key = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
    return (mix64(key) % np.uint64(buckets)).astype(np.int64)


def page_text(html: str) -> str:
    """The text of the article or main part, or of the whole page, without navigation and code."""
    body = DROPPED.sub(" ", html)
    main = MAIN.search(body)
    return markup.unescape(TAG.sub(" ", main[2] if main else body))


def address_parts(url: str) -> tuple[str, str, str]:
    """(host, registered domain, suffix) of an address; empty where there is no host."""
    found = ADDRESS.match(url.strip())
    if not found or not found[1]:
        return "", "", ""
    labels = found[1].lower().strip(".").split(".")
    return ".".join(labels), ".".join(labels[-2:]), f"{labels[-1]}/{(found[2] or '').lower()}"


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_share: np.ndarray  # (languages, buckets)


def fit_text(docs: DataFrame, options: LanguageOptions) -> TextModel:
    """Trigram shares of each language that a document has, from a sample of the documents of each.

    A language is sampled by a hash of the id (of the text, without one) at the rate that leaves about
    `sample` documents, and whole up to that size; counts are summed in Spark. The result has every
    language and a fixed number of buckets.
    """
    known = docs.where("lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    place = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("lang"))).otherwise(F.xxhash64("text")), F.lit(1 << 31))
    rates = [(lang, int(options.sample / n * (1 << 31))) for lang, n in sizes.items() if n > options.sample]
    cut = docs.sparkSession.createDataFrame(rates, "lang string, below bigint")
    chosen = known.select("lang", F.coalesce("text", F.lit("")).alias("text"), place.alias("place")).join(F.broadcast(cut), "lang", "left")
    chosen = chosen.where("below IS NULL OR place < below").select("lang", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, buckets, counts = [], [], []
        labels = batch.column("lang").to_pylist()
        for lang in sorted(set(labels)):
            parts = [trigram_buckets(t.as_py(), options.buckets) for own, t in zip(labels, batch.column("text"), strict=True) if own == lang]
            total = np.bincount(np.concatenate(parts), minlength=options.buckets)
            some = np.flatnonzero(total)
            langs += [lang] * len(some)
            buckets.append(some)
            counts.append(total[some])
        arrays = [pa.array(langs, pa.string()), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(counts).astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    rows = map_batches(chosen, work, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted(sizes)) or ("und",)
    counts = np.full((len(languages), options.buckets), options.smoothing)
    at = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        counts[at[r.lang], r.bucket] += r.n
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def text_evidence(text: str, model: TextModel, options: LanguageOptions) -> np.ndarray:
    """Log-likelihood of each language, tempered: n trigrams count as e (1 - exp(-n / e))."""
    found = trigram_buckets(text, model.log_share.shape[1])
    if not len(found):
        return np.zeros(len(model.languages))
    mean = model.log_share[:, found].mean(axis=1)
    return (mean - mean.max()) * options.evidence * (1 - math.exp(-len(found) / options.evidence))


FEATURES = "page_id bigint, host string, domain string, suffix string, declared string, text_log array<double>, q array<double>"


def _features(pages: DataFrame, model: TextModel, options: LanguageOptions) -> DataFrame:
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(6)]
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
            source = html.as_py()
            log = text_evidence(page_text(source), sent.value, options)
            q = np.exp(log - log.max())
            said = DECLARED.search(source)
            row = (*address_parts(url), said[1].lower() if said else "", log.tolist(), (q / q.sum()).tolist())
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.string()] * 4 + [pa.list_(pa.float64())] * 2
        arrays = [batch.column("page_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "domain", "suffix", "declared", "text_log", "q"])

    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return map_batches(rows, work, FEATURES)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the text posteriors of each group; partial sums combine before the shuffle.

    They are sums of whole multiples of 2^-40, so their order does not show in the result.
    """
    unit = float(1 << 40)
    sums = [F.sum(F.round(F.col("q")[i] * unit).cast("long")) / unit for i in range(n)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def _likelihood(rows: DataFrame, key: str, n: int, total: list[float], options: LanguageOptions) -> DataFrame:
    """(key, log P(value | language)): smoothed towards the value's share of all pages."""
    counts = _sums(rows, [key], n, "c")
    pages = max(sum(total), 1e-9)
    share = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / pages
    alpha = options.table_smoothing
    shares = [F.log((F.col("c")[i] + alpha * F.col("share") + 1e-12) / (total[i] + alpha)) for i in range(n)]
    return staged(counts.withColumn("share", share).select(key, F.array(*shares).alias(f"{key}_log")), f"language-{key}")


def _smoothed(own: Column, parent: Column, q: Column, strength: float) -> Column:
    """(own - q + strength * parent) / (size - 1 + strength), in each language."""
    left = F.zip_with(own, q, lambda c, x: F.greatest(c - x, F.lit(0.0)))
    size = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.zip_with(left, parent, lambda c, p: c + strength * p), lambda x: x / (size + strength))


def identify(pages: DataFrame, docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, posterior) of every row of (page_id, url, html).

    A null or empty page has no text evidence and rests on the other pieces; a null or malformed address
    shares the empty host. Where documents give no language, `lang` is "und". Ties go to the language
    first in order. Only narrow rows are joined: with hosts, whose size Spark checks before it broadcasts
    and whose hot keys adaptive execution splits, and with the tables of suffixes and declared languages.
    """
    model = fit_text(docs, options)
    n = len(model.languages)
    rows = staged(_features(pages, model, options), "language-features")
    sums = _sums(rows, [], n, "c").first()
    total = [float(x or 0.0) for x in (sums.c if sums else [0.0] * n)]
    whole = max(sum(total), 1e-9)
    general = F.array(*[F.lit((t + 1.0 / n) / (whole + 1.0)) for t in total])
    hosts = staged(_sums(rows, ["host", "domain"], n, "host_sum"), "language-hosts")
    domains = _sums(rows, ["domain"], n, "domain_sum")
    hosts = staged(hosts.join(domains, "domain").select("host", "host_sum", "domain_sum"), "language-host-priors")
    joined = (
        rows.join(hosts, "host").join(_likelihood(rows, "suffix", n, total, options), "suffix")
        .join(_likelihood(rows, "declared", n, total, options), "declared")
    )
    above = joined.withColumn("above", _smoothed(F.col("domain_sum"), general, F.col("q"), options.strength))
    prior = above.withColumn("prior", _smoothed(F.col("host_sum"), F.col("above"), F.col("q"), options.strength))
    logs = [F.log(F.col("prior")[i]) + F.col("text_log")[i] + F.col("suffix_log")[i] + F.col("declared_log")[i] for i in range(n)]
    fused = prior.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(name) for name in model.languages])
    best = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    return fused.select(
        "page_id",
        best(F.col("logs")).alias("lang"),
        (1.0 / mass).alias("confidence"),
        best(F.col("text_log")).alias("text_lang"),
        "declared",
        "host",
        F.transform("logs", lambda x: F.exp(x - F.col("top")) / mass).alias("posterior"),
    )
