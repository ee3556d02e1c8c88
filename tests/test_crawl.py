"""Walks over site maps, page dates, counted stages and ordered files against plain loops."""

from __future__ import annotations

import datetime
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidewire.operators import preprocess, web
from tidewire.sources import sinks

EDGES = "parent string, child string, kind string"


def walked(edges, roots):
    steps, queue = {r: 0 for r in roots}, deque(roots)
    while queue:
        at = queue.popleft()
        for p, c, kind in edges:
            if p == at and kind == "sitemap" and c not in steps:
                steps[c] = steps[at] + 1
                queue.append(c)
    lists = {p for p, _, kind in edges if kind == "sitemap"}
    links: dict = {}
    for p, c, kind in edges:
        if kind == "url" and p in steps and p not in lists:
            links[c] = min(links.get(c, 99), steps[p])
    return steps, links


def test_cycles_end(spark):
    rng = random.Random(3)
    edges = [(f"s{rng.randrange(30)}", f"s{rng.randrange(30)}", "sitemap") for _ in range(45)] + [(f"s{rng.randrange(40)}", f"u{rng.randrange(50)}", "url") for _ in range(80)]
    edges += [("s0", "s0", "sitemap"), ("s1", "s0", "sitemap"), ("s0", "s39", "sitemap"), ("s39", "u1", "url")] + edges[:5]
    visited, links = web.frontier_walk(spark.createDataFrame(edges, EDGES), ["s0", "s0"])
    want = walked(edges, ["s0"])
    assert {r.node: r.steps for r in visited.collect()} == want[0] and {r.link: r.steps for r in links.collect()} == want[1] and want[1]


def test_fifteen_steps_down(spark):
    edges = [(f"s{i}", f"s{i + 1}", "sitemap") for i in range(15)] + [("s15", f"u{i}", "url") for i in range(5)]
    visited, links = web.frontier_walk(spark.createDataFrame(edges, EDGES), ["s0"])
    assert visited.agg(F.max("steps"), F.count("*")).first()[:] == (15, 16) and {r.steps for r in links.collect()} == {15}


def test_rules(spark):
    edges = [("root", f"x.{m}.xml", "sitemap") for m in ("202312", "202401", "202402")] + [("root", "a/sitemap-root.xml", "sitemap"), ("root", "plain.xml", "sitemap")]
    edges += [("x.202312.xml", "http://h/2024/05/01/old-map", "url"), ("a/sitemap-root.xml", "http://h/bad", "url"), ("x.202402.xml", "http://h/2024/02/03/a", "url"), ("x.202401.xml", "http://h/2024/01/10/early", "url"), ("plain.xml", "http://h/undated", "url"), ("plain.xml", "http://h/video/1", "url"), ("plain.xml", "ftp://h/z", "url"), ("root", "http://h/listed-beside-maps", "url")]
    frame = spark.createDataFrame(edges, EDGES)
    rules = {"bad": r"sitemap-root\.xml$", "since": datetime.date(2024, 1, 15), "allow": "^http:", "block": ("/video/",)}
    assert {r.link for r in web.frontier_walk(frame, ["root"], **rules)[1].collect()} == {"http://h/2024/02/03/a", "http://h/undated"}
    assert [r.link for r in web.frontier_walk(frame, ["root"], max_links=1, **rules)[1].collect()] == ["http://h/2024/02/03/a"]
    assert web.frontier_walk(frame, ["a/sitemap-root.xml"], **rules)[1].collect() == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<meta content="2024-01-31T00:00:00+08:00" property="article:published_time">', "2024-01-31"),
        ("<META NAME='pubdate' CONTENT='31 Jan 2024'>", "2024-01-31"),
        ('<meta name="date" content="x"><time datetime=2024-01-31>', "2024-01-31"),
        ('<time datetime="2023-01-01"><meta itemprop="datePublished" content="2024-01-31">', "2024-01-31"),
        ('<meta name="date" content="soon"><meta name="date" content="2024-01-31">', None),
        ('<meta name="DATE" content="2024-01-31"><time>2024-01-31</time>', None),
        ('<meta data-name="date" content="2024-01-31">', None),
        ("", None),
        (None, None),
    ],
)
def test_date_probes(spark, html, want):
    got = web.published_date(spark.createDataFrame([(html,)], "html string")).first().published
    assert (got and str(got)) == want


def _corpus(spark):
    long = "Some words of the day and more of them, so that there is a body. "
    rows = [("S", "c", f"http://h/{i % 30}?utm_source=x#f", f"Title {i % 40}", "2024-01-31" if i % 7 else "soon", f"{long}Number {i % 40}. {long}And a second one here.") for i in range(100)]
    rows += [("", "c", "", "Same", "31 Jan 2024", long * 2 + "End of it, with a little more to say.")] * 3 + [("S", None, None, "Short", "2024-02-01", "x"), ("S", "c", "u", "Early", "2019-01-01", long * 3), ("S", "c", "u", None, "2024-01-01", long * 3)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, source string, category string, url string, title string, date string, body string")


def test_stages_are_counted_in_the_same_pass(spark, tmp_path):
    _corpus(spark).write.parquet(f"{tmp_path}/raw")
    df, counters = preprocess.preprocess(spark.read.parquet(f"{tmp_path}/raw"), datetime.date(2020, 1, 1), "row")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    told = sinks.counted(df, counters, f"{tmp_path}/out")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/rows")
    dated = [r for r in _corpus(spark).collect() if r.date != "soon"]
    recent = [r for r in dated if r.date != "2019-01-01"]
    full = [r for r in recent if r.title and len(r.body) > 50]
    by_url = {}
    for r in full:
        by_url.setdefault(r.url.split("?")[0] if r.url else f"row {r.row}", r)
    by_text = {(r.title, r.body.lower()) for r in by_url.values()}
    assert told == {"rows_loaded": 106, "rows_with_valid_date": len(dated), "rows_after_min_date": len(recent), "rows_after_text_filters": len(full), "rows_after_url_dedupe": len(by_url), "rows_after_text_dedupe": len(by_text), "rows_dropped_duplicate_url": len(full) - len(by_url), "rows_dropped_duplicate_text": len(by_url) - len(by_text)}
    assert rows.count() == told["rows_after_text_dedupe"] and spark.read.json(f"{tmp_path}/out/report").first().asDict() == told
    kept = rows.where("title = 'Same'").collect()
    assert len(kept) == 1 and kept[0].source == "unknown_source" and kept[0].date == "2024-01-31" and kept[0].row == "100"


def test_files_follow_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randint(0, 50), str(i)) for i in range(2000)]
    sinks.ordered(spark.createDataFrame(rows, "k string, n int, t string").repartition(7), f"{tmp_path}/out", "k", "n", partitions=8)
    files = sorted((tmp_path / "out").glob("part-*"))
    got = [line for f in files for line in f.read_text().splitlines()[1:]]
    want = [f"{k or ''},{n},{t}" for k, n, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))]
    assert len(files) == 8 and [x.replace('""', "") for x in got] == want
