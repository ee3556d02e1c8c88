"""The pipeline's stages, each on its own input, and the whole."""

from __future__ import annotations

import re

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        before = {r.doc_id: r for r in docs.collect()}
        assert {r.doc_id for r in rows} <= before.keys()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "secret_scan":
            assert len(rows) == len(before) and not any(re.search("[0-9a-f]{24,}", r.text) for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "sentencepiece":
            assert len(rows) == len(before) and all(r.decoded_ok and r.n_tokens == len(r.ids) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)


def test_run_equals_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).count()
    assert 0 < got < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_near_copies_link_by_five_words_from_four_fifths(spark, sf_dir):
    words = [f"w{i}" for i in range(400)]
    changed = words[:100] + [f"n{i}" for i in range(36)] + words[136:]
    a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (words, changed))
    assert 0.8 <= len(a & b) / len(a | b) < 0.82
    apart = words[:100] + [f"m{i}" for i in range(60)] + words[160:]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, changed, apart))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline._near_copies(spark, docs, sf_dir).collect()) == [0, 2]
