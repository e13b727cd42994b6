"""The pipeline: each stage does what it says, and the whole equals its stages."""

from __future__ import annotations

import re

from fixtures import documents, labels

import corpus_pipeline
from marginalia.llm import compression, secret_scan
from marginalia.llm.queries import vocabulary
from marginalia.llm.packing import encoder


def test_stages_on_the_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mixed", "packed"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf_dir)
    model = compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = {r.doc_id for r in compression.score(docs, model).where("score >= 0.7").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted
    single = stages["near_duplicates"](spark, docs, sf_dir)
    assert single.columns == docs.columns and 0 < single.count() < docs.count()
    clean = stages["secrets"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert all(not secret_scan.scan(r.text) for r in clean.collect())
    mixed = stages["mixed"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    words = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in f.collect()) for f in (docs, mixed)]
    assert abs(words[1] - 1.5 * words[0]) < 50


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    texts = [r.text for r in docs.collect()]
    encode = encoder(vocabulary()).encode
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in rows) == sum(len(encode(t)) // 4 + 1 for t in texts)
    assert all(r.length & (r.length - 1) == 0 for r in rows) and len({r.sequence_id for r in rows}) == len(rows)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    labels(spark, [(1, 1, 0), (7, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (documents(spark, extra=True), documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert name == "packed" or out.columns == frame.columns
            assert out.count() >= 0
