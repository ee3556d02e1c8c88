"""Alignment, statistics, sampling, models, sources and streams against plain computations."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.operators import chat, corpus, market, models, stats, web
from tidewire.sources import readers, sinks
from tidewire.streaming import daily as streaming

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("mode", ["same_or_next", "next_only"])
def test_alignment_equals_as_of(spark, mode):
    rng = random.Random(4)
    for _ in range(4):
        days = sorted(rng.sample(range(60), 12))
        rows = [(i, DAY + datetime.timedelta(rng.randrange(-5, 65))) for i in range(80)]
        calendar = spark.createDataFrame([(DAY + datetime.timedelta(d),) for d in days], "market_date date")
        got = {r.id: r.market_date for r in market.align(spark.createDataFrame(rows, "id int, calendar_date date"), calendar, mode).collect()}
        left = pd.DataFrame(rows, columns=["id", "d"]).assign(d=lambda f: pd.to_datetime(f["d"])).sort_values("d")
        right = pd.DataFrame({"d": pd.to_datetime([DAY + datetime.timedelta(d) for d in days])}).assign(m=lambda f: f["d"])
        want = pd.merge_asof(left, right, on="d", direction="forward", allow_exact_matches=mode == "same_or_next").dropna()
        assert got == {r.id: r.m.date() for r in want.itertuples()}


def test_smoothing_cases(spark):
    gaps = spark.createDataFrame([(0, DAY + datetime.timedelta(i), x) for i, x in enumerate([None, 1.0, None, 2.0, None, None, 4.0])], "ticker int, date date, close double")
    got = [r.e for r in market.smoothed(gaps, {"e": ("close", 0.5)}).orderBy("date").collect()]
    assert got == [None, 1, 1, 1.5, 1.5, 1.5, 2.75]
    few = spark.createDataFrame([(0, DAY + datetime.timedelta(i), float(i + 1)) for i in range(3)], "ticker int, date date, close double")
    assert [r.e for r in market.smoothed(few, {"e": ("close", market.span(3))}).orderBy("date").collect()] == pytest.approx([1, 1.5, 2.25])
    rising = spark.createDataFrame([(0, DAY + datetime.timedelta(i), float(i + 1)) for i in range(30)], "ticker int, date date, close double")
    assert {r.rsi for r in market.rsi(rising).collect()} == {50.0}


def test_split_points(spark):
    train, val = market.split_points(F.lit(100), 10)
    assert tuple(spark.range(1).select(train, val).first()) == (70, 85)


def test_p_values():
    assert stats.t_p_value(1.0, 1) == pytest.approx(0.5) and stats.t_p_value(2.0, 2) == pytest.approx(1 - 2 / np.sqrt(6))
    assert stats.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.f_p_value(4.0, 1, 12) == pytest.approx(stats.t_p_value(2.0, 12)) and stats.f_p_value(3.49, 3, 12) == pytest.approx(0.05, abs=2e-4)


def test_granger_finds_the_cause():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = np.append(0, 0.8 * x[:-1]) + 0.1 * rng.normal(size=300)
    forth, back = stats.granger_tests(x, y, 2), stats.granger_tests(y, x, 2)
    assert forth[0][2] < 1e-12 and back[0][1] < forth[0][1] / 50 and forth[1][3:] == (300 - 2 - 4 - 1, 2)
    assert stats.granger_tests(x[:20], y[:20], 2) == []


def test_direction_and_minimum(spark):
    rows = [(1.0, 0.1), (-1.0, 0.2), (0.0, 0.3), (2.0, -0.1), (-3.0, -0.2)]
    got = stats.lag_metrics(spark.createDataFrame(rows, "signal double, ret double")).first()
    assert (got.directional_accuracy, got.directional_coverage, got.n_rows) == (0.5, 0.8, 5)
    few = stats.lag_metrics(spark.createDataFrame(rows[:4], "signal double, ret double")).first()
    assert few.n_rows == 4 and few.pearson_r is None and few.directional_accuracy is None
    flat = stats.lag_metrics(spark.createDataFrame([(1.0, x) for _, x in rows], "signal double, ret double")).first()
    assert flat.pearson_r is None


def test_quota(spark):
    sizes = {"a": 1, "b": 5, "c": 5, "d": 0}
    got = corpus.even_quota(spark.createDataFrame(list(sizes.items()), "g string, n int"), "g", "n", 5)
    assert {r.g: r.quota for r in got.collect()} == {"a": 1, "b": 2, "c": 2}


def test_exact_split(spark):
    got = corpus.exact_split(spark.range(1003).select(F.col("id")), corpus.hashed(1, "id")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 802, "validation": 100, "test": 101}


def test_aliases(spark):
    rows = spark.createDataFrame([("CIMBs rally",), ("CIMB, others",), ("xTenaga  NasionalY",)], "title string")
    specs = [corpus.Company("1", "One", ("CIMB",)), corpus.Company("2", "Two", ("Tenaga Nasional",))]
    got = {(r.title, r.ticker) for r in corpus.companies(rows, specs, ("title",)).collect()}
    assert got == {("CIMB, others", "1"), ("xTenaga  NasionalY", "2")}


def test_loose_exclusion_removes_one_row_each(spark):
    long = "".join(chr(97 + i % 26) for i in range(300))
    rows = spark.createDataFrame([(i, "d", long + str(i)) for i in range(3)] + [(9, "e", long)], "id int, date string, text string")
    held = spark.createDataFrame([(1, "d", long[:130]), (2, "d", long[:100])], "h int, date string, text string")
    assert sorted(r.id for r in corpus.exclude_loose(rows, held, "id").collect()) == [1, 2, 9]


REPLIES = {
    'x\n```json\n{"rows": [{"row_id": "row_1", "label": "bullish"}]}\n```': {"row_1": "pos"},
    '[["row_1", "neg"], ["row_2"]]': {"row_1": "neg"},
    '[{"row_id": "row_1", "label": "neg"}, 3, "x", {"label": "pos"}]': {"row_1": "neg"},
    '{"row_1": "negative", "row_2": 5, "row_3": {"label": "pos"}}': {"row_1": "neg", "row_3": "pos"},
    "Sure:\nrow_id,label\nrow_1,pos": {"row_1": "pos"},
    'Note, that\n```csv\nn,LABEL,row_id\n1,"It is, in all, positive",row_7\n```': {"row_7": "pos"},
    "row_1: neutral": {"row_1": "neut"},
    "row_1 - neg\nrow_2:pos\nrow_1: pos": {"row_1": "pos", "row_2": "pos"},
    "| row_1 | mixed |\n|---|---|": {"row_1": "neut"},
    "row_1\tbearish\n\n'row_2'\tpos": {"row_1": "neg", "row_2": "pos"},
    "```\nnothing here\n```\nrow_9: neg": {"row_9": "neg"},
    "```\nrow_1: pos\n```\n```\nrow_1: neg\n```": {"row_1": "pos"},
    "a,b\nc": {},
    "```": {},
    "[[]]": {},
    "{": {},
    "": {},
    None: {},
    "long text, of " * 20_000 + "\nrow_1: pos": {"row_1": "pos"},
}


def test_replies(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "id int, content string")
    got: dict = {i: {} for i in range(len(REPLIES))}
    for r in chat.parse_replies(df, "content", "id").collect():
        got[r.id][r.row_id] = r.label
    for (text, want), told in zip(REPLIES.items(), got.values(), strict=True):
        assert told == want, text


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet=st.sampled_from('{}[]"\'`,|\t\n: -row_1posneg'), max_size=60), min_size=200, max_size=200))
def test_any_reply_parses(spark, texts):
    rows = chat.parse_replies(spark.createDataFrame([(x,) for x in texts], "content string"), "content").collect()
    assert all(r.row_id and r.label in ("pos", "neg", "neut") for r in rows)


def test_consensus(spark):
    rows = [("pos",) * 3, ("pos", "pos", ""), ("pos", "pos", "neg")]
    got = [r.c for r in spark.createDataFrame(rows, "a string, b string, c3 string").select(chat.consensus(["a", "b", "c3"]).alias("c")).collect()]
    assert got == ["pos", "", "mixed"]


def test_batched_model(spark):
    frame = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.generated for r in models.batched_scores(frame, "t", lambda: lambda xs: [x + "!" for x in xs]).collect()] == ["a!", "!"]


def test_links(spark):
    page = spark.createDataFrame([(1, "http://a.b/c/d", '<a href="/x#y"><a class=k href=\'e\'><a href="http://q/z"><a href="//m.n/o">')], "page_id int, url string, html string")
    assert {r.link for r in web.links(page, "^http", ("/z$",)).collect()} == {"http://a.b/x", "http://a.b/c/e", "http://m.n/o"}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿date,text\n2024-01-01,\"x, \"\"y\"\"\nz\"\n,\n".encode())
    (tmp_path / "b.csv").write_bytes("date,text\n2024-01-02,café\n".encode("cp1252"))
    got = readers.corpus_date_text(spark, f"{tmp_path}/a.csv").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", 'x, "y"\nz'), ("", "")]
    assert {r.text for r in readers.csv_any_encoding(spark, f"{tmp_path}/*.csv").collect()} == {'x, "y"\nz', "", "café"}
    assert readers.csv_typed(spark, f"{tmp_path}/a.csv", "date date, text double").first().asDict() == {"date": DAY, "text": None}
    with pytest.raises(ValueError, match="no column"):
        (tmp_path / "c.csv").write_text("x,y\n1,2\n")
        readers.corpus_date_text(spark, f"{tmp_path}/c.csv")
    assert [tuple(r) for r in readers.labelled_pairs(spark, f"{tmp_path}/c.csv").collect()] == [("x", "y"), ("1", "2")]


def test_recursive_and_standard(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.csv").write_text("Headline,content\nT,B\n")
    spark.createDataFrame([("P", "Q")], "Headline string, content string").write.parquet(f"{tmp_path}/in/p.parquet")
    rows = readers.standard_articles(readers.recursive(spark, f"{tmp_path}/in")).collect()
    assert {(r.title, r.body, r.url) for r in rows} == {("T", "B", ""), ("P", "Q", "")}


def test_paged_source(spark):
    readers.register(spark, "numbers", "n int", lambda offset: iter([(offset,), (offset + 1,)]))
    assert sorted(r.n for r in spark.read.format("numbers").option("step", 10).option("pages", 3).load().collect()) == [0, 1, 10, 11, 20, 21]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("k", "a,b"), ("l", 'c"d')], "key string, text string")
    sinks.csv(frame, f"{tmp_path}/csv")
    assert {tuple(r) for r in readers.csv_strings(spark, f"{tmp_path}/csv").collect()} == {("k", "a,b"), ("l", 'c"d')}
    sinks.csv_with_mark(frame, f"{tmp_path}/mark")
    assert next((tmp_path / "mark").glob("part-*")).read_text().startswith("﻿key,text\n")
    sinks.by_entity(frame, f"{tmp_path}/by", "key", ["text"])
    sinks.bundle(frame, f"{tmp_path}/bundle", "T", "t")
    sinks.report(frame, f"{tmp_path}/report")
    assert (tmp_path / "by" / "rich" / "key=k").is_dir() and spark.read.json(f"{tmp_path}/report").count() == 2


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("score", F.col("value"))
    events.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    streaming.to_table(streaming.daily(source), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {r.day: r.article_count for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.d: r["count"] for r in events.groupBy(F.to_date("ts").alias("d")).count().collect()}
    assert got and all(want[d] == n for d, n in got.items()) and len(want) - len(got) <= 4


def test_pipeline_steps(spark, tmp_path, sf_dir):
    from tidewire.plans import pipeline

    paths = pipeline.run(spark, sf_dir, str(tmp_path), ["evaluate"])
    assert len(paths) == 4 and spark.read.json(paths[0]).count() == 3
    with pytest.raises(ValueError, match="no step"):
        pipeline.run(spark, sf_dir, str(tmp_path), ["what"])


def test_company_selection():
    specs = [corpus.Company("1155", "Malayan Banking", ("maybank",)), corpus.Company("1023", "CIMB Group", ("cimb",))]
    names = lambda *w: [c.ticker for c in corpus.select_companies(specs, list(w))]
    assert names() == ["1155", "1023"] and names("cimb group") == ["1023"] and names("malayan_banking,1023") == ["1155", "1023"]
    with pytest.raises(ValueError):
        names("other")


def test_price_errors(spark):
    rows = [("a", 10.0, 11.0, 12.0), ("a", 10.0, 9.0, 10.5), ("a", 10.0, 0.0, 9.0), ("a", 10.0, 10.0, 11.0)]
    got = stats.regression_metrics(spark.createDataFrame(rows, "k string, now double, actual double, predicted double"), "k", current="now").first()
    assert got.mape == pytest.approx(100 * (1 / 11 + 1.5 / 9 + 0.1) / 3)
    assert got.directional_accuracy == pytest.approx(2 / 3) and got.directional_coverage == 0.75
