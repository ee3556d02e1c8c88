"""Copies are collapsed before anything is posted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm import jaccard_join


def test_postings_do_not_grow_with_copies(spark):
    words = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(words)) for i in range(400)] + [(1000 + i, " ".join(words[i:] + ["x"] * i)) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8).withColumn("mark", F.xxhash64("text"))
    profile = jaccard_join._profile(df, 4, 85).where("n > 0")
    groups = profile.select("grp", "prefix").distinct().agg(F.sum(F.size("prefix")), F.count("*")).first()
    posted = jaccard_join._posted(profile, 85)
    assert posted.count() == groups[0] < 200 and groups[1] <= 5
    assert posted.groupBy("token", "grp").count().where("count > 1").isEmpty()
