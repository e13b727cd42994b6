"""One query per operator: `name -> (spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fixtures as fx
from marginalia.functions import strings as S
from marginalia.operators import authors, cards, lines, report, select, similarity, state, text, vectors
from marginalia.options import ModelOptions, RecommendOptions
from marginalia.plans.daily import daily_job as run_daily
from marginalia.plans.daily import read_state
from marginalia.plans.daily import vector_store as daily_vectors
from marginalia.plans.recommend import daily_report
from marginalia.plans.recommend import recommend as recommend_plan
from marginalia.plans.recommend import recommend_records
from marginalia.session import scratch_path
from marginalia.sources import files, tables
from marginalia.sources import papers as records
from marginalia.sources.records import insert_records, write_records
from marginalia.sources.vector_store import VectorStore, refresh
from marginalia.streaming.daily import poll_with_state as poll_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY_REPORT = ["run_date"]
BY_SECTION = ["run_date", "section"]
PAIR_FLOOR = 0.25
THRESHOLD = 0.3
BAND_THRESHOLD = 0.5
CATEGORIES = ("src3", "src7", "fr")
STOPWORDS = ("the", "of", "and", "le", "la", "un", "der", "die", "que")
MODEL = ModelOptions("hashing", True, "base", "adapter")
WINDOW_DAYS = 100_000  # wider than any table: nothing is cut off


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# Sources and sinks


def _record_files(spark, sf_dir):
    """(key, content) of the papers under file names, which sort as the numbers of the papers do."""
    title = F.substring("title", 1, 40)
    named = fx.papers(spark, sf_dir).withColumn("key", records.paper_key(F.lpad(F.col("key").cast("string"), 12, "0"), title))
    return records.render_records(named, keep=("categories",))


@query
def scan_text_corpus(spark, sf_dir):
    """One file per record, named by its key, and read back."""
    path = scratch_path(spark, "corpus")
    write_records(_record_files(spark, sf_dir), path, F.col("content"))
    return files.scan_text_corpus(spark, path).select("key", S.line_field(F.col("content"), "URL:").alias("url"), "content")


@query
def insert_record_files(spark, sf_dir):
    """French papers in an older wording first, which inserting all papers leaves alone."""
    path = scratch_path(spark, "inserted")
    corpus = _record_files(spark, sf_dir)
    french = corpus.where(F.array_contains("categories", "fr")).withColumn("content", F.concat(F.lit("old "), "content"))
    for batch in (french, corpus):
        insert_records(batch, path, F.col("content"))
    return files.scan_text_corpus(spark, path).select("key", "content")


@query
def recommend_directory(spark, sf_dir):
    """From a directory of record files to the best of each section."""
    path = scratch_path(spark, "candidates")
    write_records(_record_files(spark, sf_dir), path, F.col("content"))
    found = recommend_records(
        files.scan_text_corpus(spark, path), fx.encode(fx.own_texts(spark, sf_dir)),
        fx.black_names(spark, sf_dir), fx.white_names(spark, sf_dir), fx.encode, ALL_DAYS,
    )
    return found.withColumn("score", F.round("score", 6))


@query
def scan_name_list(spark, sf_dir):
    path = scratch_path(spark, "names")
    lines = fx.papers(spark, sf_dir).select(
        F.explode(F.transform("authors", lambda a: F.concat(F.lit(" \t"), a, F.lit("\xa0 \n  ")))).alias("value")
    )
    lines.write.text(path)
    return files.scan_name_list(spark, path)


@query
def render_records(spark, sf_dir):
    return records.render_records(fx.papers(spark, sf_dir))


@query
def paper_key(spark, sf_dir):
    identifier = records.own_paper_id(F.concat(F.lit("http://h/abs/"), F.col("key").cast("string"), F.lit("v1")))
    return fx.papers(spark, sf_dir).select(
        "key",
        records.paper_key(identifier, F.col("title")).alias("candidate_key"),
        records.paper_key(identifier, F.col("title"), records.OWN_KEY_CHARS).alias("own_key"),
    )


def _orders(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders")


@query
def insert_new(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    path = scratch_path(spark, "customers")
    tables.append_new(spark, path, orders.where(urgent), "o_custkey", F.col("o_orderkey"))
    tables.append_new(spark, path, orders.where(~urgent), "o_custkey", F.col("o_orderkey"))
    return spark.read.parquet(path)


@query
def overwrite_by_key(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return tables.overwrite_by_key(events, "user_id", F.col("event_id"))


@query
def replace_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    yesterday = fx.scored_papers(spark, sf_dir).select("key", "section")
    tables.replace_snapshot(yesterday, path)
    routed = authors.route_priority(
        fx.corpus(spark, sf_dir), fx.black_names(spark, sf_dir), fx.white_names(spark, sf_dir)
    )
    tables.replace_snapshot(routed.select("key", "section"), path)
    return tables.read_snapshot(spark, path, "key bigint, section string")


@query
def author_papers(spark, sf_dir):
    builders = fx.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    found = records.author_papers(_orders(spark, sf_dir), builders, "o_custkey")
    return found.select("o_custkey", "o_orderkey", "o_totalprice")


@query
def vector_table(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    tables.write_vectors(fx.my_vectors(spark, sf_dir).unionByName(fx.new_vectors(spark, sf_dir)), path)
    return tables.read_vectors(spark, path).select("key", "label", fx.micro(F.col("vec")).alias("vec"))


# Filters, windows, top-N


@query
def category_filter(spark, sf_dir):
    return select.category_filter(fx.papers(spark, sf_dir), CATEGORIES).select("key", "title")


@query
def latest_timestamp(spark, sf_dir):
    latest = select.latest_timestamp(fx.table(spark, sf_dir, "events"), "ts")
    return latest.select(stamp("latest").alias("latest"))


@query
def recent_window(spark, sf_dir):
    recent = select.recent_window(
        fx.table(spark, sf_dir, "events"),
        ("click", "purchase"),
        days=1,
        published="ts",
        categories_column="event_type",
        tie="event_id",
    )
    return recent.select("event_id", stamp("ts").alias("ts"), "event_type")


@query
def recent_window_ties(spark, sf_dir):
    recent = select.recent_window(_orders(spark, sf_dir), days=30, published="o_orderdate", tie="o_orderkey")
    return recent.select("o_orderkey", stamp("o_orderdate").alias("o_orderdate"))


@query
def recent_window_newest(spark, sf_dir):
    newest = select.recent_window(_orders(spark, sf_dir), days=0, cap=None, published="o_orderdate")
    return newest.select("o_orderkey", stamp("o_orderdate").alias("o_orderdate"))


def _scores(spark, sf_dir):
    scores = similarity.score_candidates(fx.new_vectors(spark, sf_dir), fx.my_vectors(spark, sf_dir))
    return scores.withColumn("score", F.round("score", 6))


@query
def score_candidates(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def score_threshold(spark, sf_dir):
    return select.score_threshold(_scores(spark, sf_dir), THRESHOLD).select("key", "score")


@query
def top_n(spark, sf_dir):
    return select.top_n(_scores(spark, sf_dir), 20).select("key", "score")


@query
def top_n_per_section(spark, sf_dir):
    return select.top_n_per_section(_scores(spark, sf_dir), 5, by=("label",)).select("label", "rank", "key", "score")


@query
def retain_last_n(spark, sf_dir):
    return select.retain_last_n(fx.reports(spark, sf_dir), 7)


# Text to columns


@query
def line_field(spark, sf_dir):
    return text.with_line_field(fx.corpus(spark, sf_dir), "content", "Title:", "title").select("key", "title")


@query
def block_field(spark, sf_dir):
    corpus = fx.corpus(spark, sf_dir)
    return text.with_block_field(corpus, "content", "Abstract:", "Date:", "block").select("key", "block")


@query
def parse_records(spark, sf_dir):
    return text.parse_records(fx.corpus(spark, sf_dir))


@query
def compose_text(spark, sf_dir):
    return text.compose_text(fx.corpus(spark, sf_dir))


@query
def substitute_separator(spark, sf_dir):
    return text.substitute_separator(text.compose_text(fx.corpus(spark, sf_dir)), "</s>")


@query
def explode_authors(spark, sf_dir):
    return authors.explode_authors(fx.corpus(spark, sf_dir))


@query
def normalize_names(spark, sf_dir):
    exploded = authors.explode_authors(fx.corpus(spark, sf_dir))
    return authors.normalize_names(exploded, "author").select("key", "pos", "first", "last")


@query
def tokenize_stopwords(spark, sf_dir):
    texts = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    tokens = text.tokenize_stopwords(texts, STOPWORDS)
    return tokens.select("key", F.array_join("tokens", " ").alias("tokens"))


# Authors


@query
def author_match(spark, sf_dir):
    exploded = authors.explode_authors(fx.corpus(spark, sf_dir))
    return authors.author_match(exploded, fx.white_names(spark, sf_dir))


@query
def author_match_loose(spark, sf_dir):
    exploded = authors.explode_authors(fx.corpus(spark, sf_dir))
    return authors.author_match(exploded, fx.white_names(spark, sf_dir), "loose")


@query
def exclude_authors(spark, sf_dir):
    return authors.exclude_authors(fx.corpus(spark, sf_dir), fx.black_names(spark, sf_dir)).select("key")


def _routing(spark, sf_dir):
    return fx.corpus(spark, sf_dir), fx.black_names(spark, sf_dir), fx.white_names(spark, sf_dir)


@query
def route_priority(spark, sf_dir):
    return authors.route_priority(*_routing(spark, sf_dir)).select("key", "section")


@query
def routing_counts(spark, sf_dir):
    return authors.routing_counts(*_routing(spark, sf_dir))


@query
def flag_authors(spark, sf_dir):
    parsed = text.parse_records(fx.corpus(spark, sf_dir))
    flagged = authors.flag_authors(parsed, fx.white_names(spark, sf_dir), ["key"])
    spelled = F.transform("flags", lambda f: F.concat(f["name"], F.when(f["hit"], "=yes").otherwise("=no")))
    return flagged.select("key", F.array_join(spelled, "; ").alias("flags"))


# Vectors and similarity


@query
def cosine_pairs(spark, sf_dir):
    pairs = similarity.cosine_pairs(fx.new_vectors(spark, sf_dir), fx.my_vectors(spark, sf_dir), PAIR_FLOOR)
    return pairs.withColumn("sim", F.round("sim", 6))


GROUPED_BYTES = 16_384  # small enough that the own set is cut into groups on every table


@query
def cosine_pairs_grouped(spark, sf_dir):
    """The pairs again, found without a broadcast of the own set."""
    pairs = similarity.cosine_pairs(fx.new_vectors(spark, sf_dir), fx.my_vectors(spark, sf_dir), PAIR_FLOOR, GROUPED_BYTES)
    return pairs.withColumn("sim", F.round("sim", 6))


@query
def score_candidates_grouped(spark, sf_dir):
    """The best scores again, found without a broadcast of the own set."""
    found = similarity.score_candidates(fx.new_vectors(spark, sf_dir), fx.my_vectors(spark, sf_dir), GROUPED_BYTES)
    return found.select("key", "label", F.round("score", 6).alias("score"))


@query
def max_similarity(spark, sf_dir):
    """The maximum over all own vectors for every incoming one; no pair is written for it."""
    return _scores(spark, sf_dir).select("key", "score")


@query
def check_dims(spark, sf_dir):
    return vectors.check_dims(fx.new_vectors(spark, sf_dir), fx.my_vectors(spark, sf_dir))


@query
def l2_normalize(spark, sf_dir):
    every = fx.table(spark, sf_dir, "embeddings")
    scaled = every.select(
        "vec_id", F.transform("embedding", lambda x: (x * F.col("label")).cast("float")).alias("vec")
    )
    return vectors.l2_normalize(scaled).select("vec_id", fx.micro(F.col("vec")).alias("vec"))


@query
def mean_pool(spark, sf_dir):
    return vectors.mean_pool(fx.tokens(spark, sf_dir)).select("key", fx.micro(F.col("vec")).alias("vec"))


@query
def first_token_pool(spark, sf_dir):
    return vectors.first_token_pool(fx.tokens(spark, sf_dir)).select("key", fx.micro(F.col("vec")).alias("vec"))


@query
def embed(spark, sf_dir):
    return fx.text_vectors(spark, sf_dir).select("key", fx.micro(F.col("vec")).alias("vec"))


def hashing_encoder_factory(dim: int = vectors.HASH_DIM):
    """The hashing encoder once more, as a Python encoder."""

    def factory():
        from hashlib import md5

        import numpy as np

        def encoder(batch):
            words = [item.lower().split() for item in batch]
            known = {word: int(md5(word.encode()).hexdigest()[:8], 16) % dim for word in {w for ws in words for w in ws}}
            rows = np.repeat(np.arange(len(batch)), [len(ws) for ws in words])
            buckets = np.array([known[w] for ws in words for w in ws], dtype=np.int64)
            return np.bincount(rows * dim + buckets, minlength=len(batch) * dim).reshape(len(batch), dim)

        return encoder

    return factory


@query
def embed_encoder(spark, sf_dir):
    embedded = vectors.embed(text.compose_text(fx.corpus(spark, sf_dir)), hashing_encoder_factory())
    return embedded.select("key", fx.micro(F.col("vec")).alias("vec"))


def hashing_model_factory(dim: int = vectors.HASH_DIM):
    """The hashing encoder as a tokenizer, whose ids are the buckets of words, and a forward pass over padded ids."""

    def factory():
        from hashlib import md5

        import numpy as np

        def tokenize(batch):
            return [[int(md5(word.encode()).hexdigest()[:8], 16) % dim for word in item.lower().split()] for item in batch]

        def forward(ids, mask):
            rows = np.repeat(np.arange(len(ids)), mask.sum(axis=1))
            return np.bincount(rows * dim + ids[mask > 0], minlength=len(ids) * dim).reshape(len(ids), dim)

        return tokenize, forward

    return factory


@query
def embed_padded(spark, sf_dir):
    """Texts cut to 512 tokens, in batches of like length."""
    embedded = vectors.embed_padded(text.compose_text(fx.corpus(spark, sf_dir)), hashing_model_factory())
    return embedded.select("key", "n_tokens", fx.micro(F.col("vec")).alias("vec"))


# Reports


@query
def attach_records(spark, sf_dir):
    return fx.recs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query
def render_entries(spark, sf_dir):
    return fx.entries(spark, sf_dir).select("run_date", "section", "rank", "entry")


@query
def assemble_report(spark, sf_dir):
    return fx.reports(spark, sf_dir)


@query
def report_sink(spark, sf_dir):
    path = scratch_path(spark, "reports")
    made = fx.reports(spark, sf_dir)
    files.report_sink(made.withColumn("md", F.lit("draft\n")), path)
    files.report_sink(made, path)
    return files.scan_reports(spark, path).select("run_date", "md")


@query
def report_lines(spark, sf_dir):
    """Reports written in order without a value per day, and read back line by line."""
    path = scratch_path(spark, "report-parts")
    files.report_parts_sink(report.ordered_chunks(fx.entries(spark, sf_dir)), path)
    return files.scan_report_lines(spark, path)


@query
def split_line_entries(spark, sf_dir):
    """Entries found again line by line, from reports of which no day is one value."""
    path = scratch_path(spark, "report-lines")
    files.report_parts_sink(report.ordered_chunks(fx.entries(spark, sf_dir)), path)
    return lines.split_line_entries(files.scan_report_lines(spark, path))


@query
def split_sections(spark, sf_dir):
    return cards.split_sections(fx.reports(spark, sf_dir)).select("run_date", "priority", "other")


@query
def count_entries(spark, sf_dir):
    counted = cards.count_entries(cards.split_sections(fx.reports(spark, sf_dir)))
    return counted.select("run_date", "priority_n", "other_n")


def _sections(spark, sf_dir):
    return cards.section_rows(cards.split_sections(fx.reports(spark, sf_dir)), BY_REPORT)


def _entries_back(spark, sf_dir):
    return cards.split_entries(_sections(spark, sf_dir), BY_SECTION)


def _cards(spark, sf_dir):
    return cards.parse_entries(_entries_back(spark, sf_dir))


@query
def split_entries(spark, sf_dir):
    return _entries_back(spark, sf_dir)


@query
def parse_entries(spark, sf_dir):
    return _cards(spark, sf_dir)


@query
def entry_links(spark, sf_dir):
    return cards.entry_links(_sections(spark, sf_dir), BY_SECTION)


@query
def sanitize_abstract(spark, sf_dir):
    quoted = F.translate(F.replace("text", F.lit(". "), F.lit("```")), ",v", "`'")
    docs = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("key"), quoted.alias("abstract"))
    return cards.sanitize_abstract(docs)


@query
def score_bands(spark, sf_dir):
    shown = fx.scored_papers(spark, sf_dir).select(
        "key", F.when(F.col("section") == "Other", F.round("score", 4)).alias("score")
    )
    return cards.score_bands(shown, BAND_THRESHOLD)


@query
def paper_links(spark, sf_dir):
    key = F.col("key").cast("string")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("http://h/abs/"), key, F.lit("v2?context=x")),
        F.concat(F.lit("http://h/html/"), key, F.lit("#top")),
        F.concat(F.lit("http://h/pdf/"), key),
    )
    urls = (
        fx.papers(spark, sf_dir)
        .select(F.explode(forms).alias("url"))
        .unionByName(fx.table(spark, sf_dir, "pages").select("url"))
    )
    return cards.paper_links(urls, "https://papers.example/")


@query
def display_defaults(spark, sf_dir):
    other = F.col("section") == "Other"
    shown = fx.recs(spark, sf_dir).select(
        "key",
        F.when(other, F.col("title")).otherwise("").alias("title"),
        F.when(~other, F.col("url")).alias("url"),
        F.when(other, F.round("score", 4)).alias("score"),
    )
    return cards.display_defaults(shown).drop("score")


@query
def run_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    files.report_sink(fx.reports(spark, sf_dir), path)
    return cards.run_history(files.scan_reports(spark, path))


@query
def run_history_latest(spark, sf_dir):
    """The five newest of equally old files, so that the date decides; some of them cannot be read."""
    same = fx.reports(spark, sf_dir).withColumn("modified", F.lit("2024-03-01").cast("timestamp"))
    lost = F.when(~F.col("run_date").endswith("7"), F.col("md"))
    return cards.run_history(same.withColumn("md", lost), limit=5)


@query
def export_links(spark, sf_dir):
    liked = fx.table(spark, sf_dir, "labels").where("quality = 1")
    urls = liked.select(F.concat(F.lit("http://h/pdf/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"))
    links = cards.entry_links(_sections(spark, sf_dir), BY_SECTION)
    ticked = links.join(urls, "url", "left_semi").select(*BY_SECTION, "pos")
    return cards.export_links(links, ticked, BY_SECTION)


# State


def _previous_corpus(spark, sf_dir):
    """What the corpus was before: no German papers, other texts in French, some that are gone."""
    before = fx.papers(spark, sf_dir).where(~F.array_contains("categories", "de"))
    french = F.array_contains("categories", "fr")
    before = before.withColumn("abstract", F.when(french, F.upper("abstract")).otherwise(F.col("abstract")))
    return records.render_records(before).unionByName(_gone(spark, sf_dir))


def _gone(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations")
    return talk.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("key"), F.col("text").alias("content"))


@query
def changed_rows(spark, sf_dir):
    return state.changed_rows(_previous_corpus(spark, sf_dir), fx.corpus(spark, sf_dir))


@query
def changed_rows_localised(spark, sf_dir):
    return state.changed_rows_localised(_previous_corpus(spark, sf_dir), fx.corpus(spark, sf_dir))


@query
def poll_with_state(spark, sf_dir):
    """Orders arrive in three polls, some of them again; the state of the stream tells which are known."""
    folder = scratch_path(spark, "stream")
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"))
    dear = F.col("o_totalprice") > 150_000
    for batch in (orders.where(dear), orders.where(~dear), orders):
        batch.write.mode("append").parquet(f"{folder}/inbox")
        poll = (f"{folder}/inbox", ", ".join(f"{name} {kind}" for name, kind in orders.dtypes), f"{folder}/table", f"{folder}/checkpoint")
        poll_stream(spark, *poll, time="at", delay="36500 days", key="o_orderkey").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("o_orderkey", "o_custkey", "o_totalprice")


def _by_source(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return docs.select(F.col("source").alias("corpus_id"), F.col("text").alias("content"), "lang")


@query
def corpus_fingerprint(spark, sf_dir):
    return state.corpus_fingerprint(_by_source(spark, sf_dir))


@query
def model_fingerprint(spark, sf_dir):
    made = fx.new_vectors(spark, sf_dir)
    current = state.with_model_fingerprint(made.where("label > 4"), MODEL)
    older = state.with_model_fingerprint(made.where("label <= 4"), ModelOptions("older"))
    return state.stale_vectors(current.unionByName(older), MODEL).select("key", "fingerprint")


@query
def rebuild_decision(spark, sf_dir):
    docs = _by_source(spark, sf_dir)
    current = state.corpus_fingerprint(docs)
    # Last time there was no Spanish, and sources with a 1 in their name had not been seen.
    known = docs.where("lang <> 'es' AND corpus_id NOT LIKE 'src1%'")
    model = F.when(F.col("corpus_id").like("%3"), "older").when(
        F.col("corpus_id").like("%5"), state.model_fingerprint(MODEL)
    )
    last = state.corpus_fingerprint(known).withColumn("fingerprint", model)
    stored = docs.where("corpus_id <> 'src7'").select("corpus_id")
    return state.rebuild_decision(current, last, stored, state.model_fingerprint(MODEL))


@query
def incremental_vectors(spark, sf_dir):
    model = state.model_fingerprint(MODEL)
    before = fx.encode(text.compose_text(state.with_hash(_previous_corpus(spark, sf_dir))))
    path = scratch_path(spark, "own-vectors")
    # Odd hashes were made by an older model and have to be encoded again.
    older = F.substring("content_hash", 32, 1).isin("1", "3", "5", "7", "9", "b", "d", "f")
    # Vectors without a fingerprint are taken over.
    unknown = F.substring("content_hash", 31, 1).isin("0", "1", "2", "3")
    made_by = F.when(older, "older").when(~unknown, model)
    before.withColumn("fingerprint", made_by).write.parquet(path)
    now = state.incremental_vectors(fx.corpus(spark, sf_dir), spark.read.parquet(path), fx.encode, model)
    return now.select("key", "content_hash", "fingerprint", fx.micro(F.col("vec")).alias("vec"))


@query
def vector_store(spark, sf_dir):
    """Three states of a corpus: the base, a change so large that it becomes a new base, a small change."""
    model = state.model_fingerprint(MODEL)
    store = VectorStore(scratch_path(spark, "vector-store"))
    now = fx.corpus(spark, sf_dir)
    toxic = fx.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    upper = now.join(toxic, "key", "left_semi").withColumn("content", F.upper("content"))
    draft = now.join(toxic, "key", "left_anti").unionByName(upper)
    for corpus in (_previous_corpus(spark, sf_dir), draft, now):
        refresh(store, corpus, fx.encode, model)
    return store.read(spark).select("key", "content_hash", "fingerprint", fx.micro(F.col("vec")).alias("vec"))


# Whole jobs


ALL_DAYS = RecommendOptions(days=WINDOW_DAYS, top_n=20, threshold=0.1)


def _recommend(spark, sf_dir, papers=None, options=ALL_DAYS):
    return recommend_plan(
        fx.papers(spark, sf_dir) if papers is None else papers,
        fx.encode(fx.own_texts(spark, sf_dir)),
        fx.black_names(spark, sf_dir),
        fx.white_names(spark, sf_dir),
        fx.encode,
        options,
    )


@query
def recommend(spark, sf_dir):
    return _recommend(spark, sf_dir).withColumn("score", F.round("score", 6))


@query
def recommend_duplicates(spark, sf_dir):
    """Every second paper comes with an older version, which must leave no trace."""
    papers = fx.papers(spark, sf_dir)
    older = papers.where("key % 2 = 0").withColumns(
        {"published": F.col("published") - F.expr("INTERVAL '5' MINUTE"), "title": F.lit("older"), "abstract": F.lit("of the and")}
    )
    return _recommend(spark, sf_dir, papers.unionByName(older)).withColumn("score", F.round("score", 6))


@query
def recommend_window(spark, sf_dir):
    """The newest day of chosen categories: both filters of the plan at work."""
    options = RecommendOptions(categories=CATEGORIES, days=1, top_n=20, threshold=0.0)
    return _recommend(spark, sf_dir, options=options).withColumn("score", F.round("score", 6))


def _own_records(spark, sf_dir):
    text = F.concat(F.lit("Title: b\nAbstract:\n"), "text", F.lit("\nDate: d\n"))
    return fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), text.alias("content"))


@query
def daily_job(spark, sf_dir):
    """Three runs: a draft of a day, the day itself with a changed own corpus, a day without results."""
    folder = scratch_path(spark, "daily")
    papers, own = fx.papers(spark, sf_dir), _own_records(spark, sf_dir)
    black, white = fx.black_names(spark, sf_dir), fx.white_names(spark, sf_dir)
    nothing = RecommendOptions(days=WINDOW_DAYS, threshold=2.0)
    before = own.where("key % 2 = 0").withColumn("content", F.upper("content"))
    for day, corpus, options in (
        ("2024-02-01", before, nothing),
        ("2024-02-01", own, ALL_DAYS),
        ("2024-02-02", own, nothing),
    ):
        run_daily(papers, corpus, folder, black, white, fx.encode, day, options, MODEL)
    kept = read_state(spark, folder).first()
    count = daily_vectors(folder).read(spark, kept.vectors).count()
    return files.scan_reports(spark, f"{folder}/reports").select("run_date", "md", F.lit(count).alias("vectors"))


@query
def recommend_report(spark, sf_dir):
    return daily_report(_recommend(spark, sf_dir), F.lit("2024-02-01"))
