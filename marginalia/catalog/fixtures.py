"""Papers, name lists, tokens, scores and reports that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.authors import OTHER, PRIORITY
from marginalia.operators.report import assemble_report, attach_records, render_entries
from marginalia.operators.text import compose_text
from marginalia.operators.vectors import hashing_vectors
from marginalia.session import staged
from marginalia.sources.papers import render_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`; in one local process, whose tables are single files, spread over its threads."""
    docs = table(spark, sf_dir, "documents")
    context = spark.sparkContext
    return docs.repartition(context.defaultParallelism) if context.master.startswith("local[") else docs


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as paper rows; short texts have fewer authors or none."""
    return _as_papers(documents(spark, sf_dir))


def _as_papers(docs: DataFrame) -> DataFrame:
    head = F.regexp_extract("text", r"^[ \n]*((?:[^ \n]+[ \n]+){0,5}[^ \n]+)", 1)
    docs = docs.withColumn("w", F.filter(F.split(head, r"[ \n]+"), lambda w: w != ""))
    doc_id = F.col("doc_id").cast("string")

    def word(i: int) -> Column:
        return F.get("w", F.lit(i))

    names = F.array(
        F.concat(word(0), F.lit(" "), word(1)),
        F.concat(word(2), F.lit(" "), word(3)),
        F.concat(F.substring(word(4), 1, 1), F.lit(" "), word(5)),
    )
    return docs.select(
        F.col("doc_id").alias("key"),
        F.concat(F.lit("T"), doc_id, F.lit(" "), F.substring_index("text", "\n", 1)).alias("title"),
        F.filter(names, lambda name: name.isNotNull()).alias("authors"),
        F.col("text").alias("abstract"),
        F.concat(F.lit("http://h/pdf/"), doc_id, F.lit(".pdf")).alias("url"),
        (F.lit("2024-01-01").cast("timestamp") + F.col("doc_id") * F.expr("INTERVAL '37' MINUTE")).alias("published"),
        F.array("source", "lang").alias("categories"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers as labelled text records (key, content)."""
    return render_records(papers(spark, sf_dir))


def _names_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").where(F.col(label) == 1)
    authors = _as_papers(table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")).select("authors")
    # An inner explode would have all texts taken apart before the join, to filter them by their number of names.
    names = authors.select(F.explode_outer("authors").alias("name")).where(F.col("name").isNotNull())
    # A list is kept as a table, as it would be in use, and not derived again for every lookup.
    return staged(names, f"{label}-names")


def black_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of papers labelled toxic."""
    return _names_of(spark, sf_dir, "toxic")


def white_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of papers labelled as of quality."""
    return _names_of(spark, sf_dir, "quality")


def new_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of label 1 and up, as incoming vectors."""
    return _vectors(spark, sf_dir).where(F.col("label") != 0)


def my_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of label 0, as the reader's own vectors."""
    return _vectors(spark, sf_dir).where(F.col("label") == 0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label"
    )


def own_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`benchmark` items as the reader's own texts (key, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a token with an MD5-derived vector; short words are masked."""
    word = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda w: w != "")
    exploded = documents(spark, sf_dir).select(
        F.col("doc_id").alias("key"), F.posexplode(word).alias("pos", "word")
    )
    digest = F.md5("word")
    vec = F.array(*[F.ascii(F.substring(digest, i + 1, 1)) / F.lit(97.0) for i in range(8)])
    return exploded.select("key", "pos", vec.alias("vec"), (F.length("word") > 2).cast("int").alias("mask"))


def hash_score(text: Column) -> Column:
    """A score in [0, 1] from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def scored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, run_date, section, score) of every paper; other languages than English have priority."""
    lang = F.element_at("categories", 2)
    return papers(spark, sf_dir).select(
        "key",
        F.date_format("published", "yyyy-MM-dd").alias("run_date"),
        F.when(lang == "en", OTHER).otherwise(PRIORITY).alias("section"),
        hash_score(F.col("abstract")).alias("score"),
    )


def recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers ranked within their run date and section, with their records."""
    order = Window.partitionBy("run_date", "section").orderBy(F.desc("score"), "key")
    ranked = scored_papers(spark, sf_dir).withColumn("rank", F.row_number().over(order))
    return attach_records(ranked, corpus(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_entries(recs(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_report(entries(spark, sf_dir))


def encode(texts: DataFrame) -> DataFrame:
    return hashing_vectors(texts)


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(compose_text(corpus(spark, sf_dir)))


# Means of fractions often end in exactly half a millionth, where the last bit of a sum would
# decide; a step that starts elsewhere does not hang on the order of additions.
MICRO_OFFSET = 0.4142135


def micro(vec: Column) -> Column:
    """A vector as text: its elements in steps of a millionth, for an exact comparison."""
    return F.array_join(F.transform(vec, lambda x: F.floor(x.cast("double") * 1e6 + MICRO_OFFSET).cast("string")), " ")
