"""Paged services and the fetch policy on made services."""

from __future__ import annotations

import datetime
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewire.sources import paged

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "url string, day date"
DAY = datetime.date(2024, 3, 1)


def service(site, offset):
    """Newest first, ten a page; ``short`` ends, ``loop`` repeats its last page, ``many`` goes on for long."""
    page = offset // 10
    if site == "short" and page > 2:
        return []
    if site == "loop":
        page = min(page, 4)
    return [(f"http://{site}/{page * 10 + i}", DAY - datetime.timedelta(page)) for i in range(10)] + [("", DAY)]


def _read(spark, **options):
    paged.register(spark, "made_service", SCHEMA, service, "url", "day")
    return spark.read.format("made_service").options(step=10, **options).load()


def counts(df):
    return {r.site: r.n for r in df.groupBy(F.regexp_extract("url", "//([a-z]+)/", 1).alias("site")).agg(F.count("*").alias("n")).collect()}


def test_each_rule_stops(spark):
    assert counts(_read(spark, sites="short,loop,many", max_pages=8)) == {"short": 30, "loop": 50, "many": 80}
    assert counts(_read(spark, sites="many", max_links=25)) == {"many": 30}
    assert counts(_read(spark, sites="many,short", cutoff="2024-02-28")) == {"many": 30, "short": 30}
    assert counts(_read(spark, sites="many", start=50, max_pages=1)) == {"many": 10}
    assert _read(spark, sites="short", start=90).count() == 0
    rows = _read(spark, sites="many", max_pages=3)
    assert rows.rdd.getNumPartitions() == 1 and rows.select("url").distinct().count() == 30


def test_rows_before_the_cutoff_are_left_out():
    rules = paged.Rules(0, 1, step=10, cutoff=DAY)
    fresh, state = paged.Paging(0).turned([("a", DAY), ("b", DAY - datetime.timedelta(1)), ("c", "2024-03-05T10:00"), ("d", "soon"), ("a", DAY)], rules)
    assert [r[0] for r in fresh] == ["a", "c", "d"] and state.done and state.offset == 10 and len(state.seen) == 3
    assert paged.Paging(0).turned([("a", DAY)], rules)[1].done is False


def test_a_restarted_stream_gives_no_row_twice(spark, tmp_path):
    paged.register(spark, "made_stream", SCHEMA, service, "url", "day")

    def run(pages):
        source = spark.readStream.format("made_stream").options(sites="short,loop,many", step=10, max_pages=pages).load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(2)
    assert counts(spark.read.parquet(f"{tmp_path}/out")) == {"short": 20, "loop": 20, "many": 20}
    run(2)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("url").distinct().count() == 60


def test_replayed_offsets_give_the_same_rows():
    rules, sites = paged.Rules(0, 1, step=10), ["short", "loop"]
    stream = paged._Stream(rules, sites, service)
    start = stream.initialOffset()
    offsets, parts = [start], []
    for _ in range(9):
        rows, end = stream.read(offsets[-1])
        parts.append(list(rows))
        offsets.append(end)
    assert [len(p) for p in parts] == [20, 20, 20, 10, 10, 0, 0, 0, 0] and offsets[-1] == offsets[-2]
    assert list(stream.readBetweenOffsets(offsets[1], offsets[3])) == [r for s in sites for p in parts[1:3] for r in p if f"/{s}/" in r[0]]


def made_opener():
    tries: dict = {}

    def opener(url):
        tries[url] = n = tries.get(url, 0) + 1
        kind = url.rsplit("/", 1)[1]
        if kind == "gone":
            return paged.Reply(404, url)
        if kind == "closed":
            return paged.Reply(403, url)
        if kind == "busy":
            return paged.Reply(429, url)
        if kind == "soon":
            return paged.Reply(429 if n < 3 else 200, url, "late")
        if kind == "down":
            raise ConnectionError("no route")
        if kind == "broken":
            return paged.Reply(500, url) if n < 2 else paged.Reply(200, url, "up")
        if kind == "moved":
            return paged.Reply(200, "http://other/video/1", "elsewhere")
        return paged.Reply(200, url, "text")

    return opener


@pytest.mark.parametrize(
    ("kind", "state", "status", "tries", "waits"),
    [
        ("fine", "ok", 200, 1, []),
        ("gone", "skipped", 404, 1, []),
        ("closed", "skipped", 403, 1, []),
        ("busy", "throttled", 429, 4, [2.5, 5.0, 7.5]),
        ("soon", "ok", 200, 3, [2.5, 5.0]),
        ("down", "failed", None, 4, [1.0, 2.0, 3.0]),
        ("broken", "ok", 200, 2, [1.0]),
        ("moved", "blocked", 200, 1, []),
    ],
)
def test_policy(kind, state, status, tries, waits):
    slept: list = []
    got = paged.Policy(allow="^http", block=("/video/",)).get(f"http://h/{kind}", made_opener(), slept.append)
    assert (got["state"], got["status"], got["tries"], slept, got["waited"]) == (state, status, tries, waits, sum(waits))
    assert (got["html"] is not None) == (state == "ok")


def test_long_waits_are_bounded():
    slept: list = []
    paged.Policy(tries=20).get("http://h/busy", made_opener(), slept.append)
    assert max(slept) == 30.0 and len(slept) == 19


def test_a_large_host_has_several_lanes(spark):
    urls = spark.createDataFrame([(i, f"http://www.big/{'gone' if i % 5 == 0 else i}") for i in range(200)] + [(999, "http://small/soon"), (1000, None)], "id int, url string")
    got = paged.fetched(urls, "url", made_opener, sleep=lambda s: None).withColumn("part", F.spark_partition_id())
    rows = got.collect()
    assert len(rows) == 201 and sum(r.state == "skipped" for r in rows) == 40 and next(r.html for r in rows if r.id == 999) == "late"
    assert 1 < len({r.part for r in rows if "big" in r.url}) <= 4
