"""Quotas, samples with top-up, numbering and loose exclusion against plain loops, with hot keys."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import chat, corpus

DAY = datetime.date(2023, 1, 1)


def dealt(sizes: dict, n: int) -> dict:
    """Round by round, in order, to whoever still has rows."""
    out = dict.fromkeys(sizes, 0)
    while n and any(out[g] < sizes[g] for g in sizes):
        for g in sorted(sizes):
            if n and out[g] < sizes[g]:
                out[g] += 1
                n -= 1
    return {g: q for g, q in out.items() if q}


def test_quotas_equal_the_rounds(spark):
    rng = random.Random(2)
    cases = {k: ({f"g{i}": rng.choice([0, 1, 3, 10, 50]) for i in range(rng.randint(1, 7))}, rng.randint(0, 120)) for k in range(60)}
    rows = [(k, g, size, n) for k, (sizes, n) in cases.items() for g, size in sizes.items()]
    got: dict = {k: {} for k in cases}
    for r in corpus.quotas(spark.createDataFrame(rows, "k int, g string, size bigint, n bigint"), "g", "size", "n", "k").collect():
        got[r.k][r.g] = r.quota
    assert got == {k: dealt(*case) for k, case in cases.items()}


def test_a_hot_group_is_not_ranked_whole(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 100 < 97, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"))
    quota = spark.createDataFrame([("hot", 5000), ("g97", 30), ("g98", 10**6), ("none", 4)], "g string, quota bigint")
    order = corpus.hashed(1, "id")
    got = corpus.sample_by_quota(df, quota, "g", order)
    rows: dict = {}
    for r in got.collect():
        rows.setdefault(r.g, set()).add(r.id)
    want = sorted((i for i in range(200_000) if i % 100 < 97), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())[:5000]
    assert rows["hot"] == set(want) and len(rows["g97"]) == 30 and len(rows["g98"]) == 2000 and set(rows) == {"hot", "g97", "g98"}
    # the ranked rows are those of the boundary range alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_n" in plan and "windowspecdefinition(g" in plan and "_b" in plan


def _articles(spark, labels):
    rows = [(i, DAY + datetime.timedelta(i * 7 % 720), labels(i)) for i in range(600)] + [(1000, None, "positive")]
    return spark.createDataFrame(rows, "id int, date date, raw string")


def test_labels_then_months_then_top_up(spark):
    df = _articles(spark, lambda i: "negative" if i % 60 == 0 else "positive" if i % 10 == 3 else "odd" if i % 2 else None)
    got = corpus.sample_years(df, {2023: 100, 2024: 40}, "date", "id", F.col("raw")).collect()
    assert len({r.id for r in got}) == len(got) == 140 and {r.sample_strategy for r in got} == {corpus.BY_LABEL}
    source = {r.id: r for r in df.collect()}
    for year, n in ((2023, 100), (2024, 40)):
        mine = [r for r in got if r.sample_target_year == year]
        caps: dict = {}
        for r in source.values():
            if r.date and r.date.year == year and r.raw in ("negative", "positive"):
                caps.setdefault(r.raw, []).append(r)
        want = dealt({k: len(v) for k, v in caps.items()}, n)
        told: dict = {}
        for r in mine:
            told[r.sample_sentiment_bucket] = told.get(r.sample_sentiment_bucket, 0) + 1
        assert len(mine) == n and {k: v for k, v in told.items() if k} == want
        for label, rows in caps.items():
            months = dealt({m: sum(r.date.strftime("%Y-%m") == m for r in rows) for m in {r.date.strftime("%Y-%m") for r in rows}}, want[label])
            assert months == {m: sum(r.sample_month == m and r.sample_sentiment_bucket == label for r in mine) for m in months}
        assert told[""] == n - sum(want.values())


def test_samples_without_valid_labels(spark):
    df = _articles(spark, lambda i: "odd")
    a, b = (corpus.sample_years(df, {2024: 30}, "date", "id", label).collect() for label in (None, F.col("raw")))
    assert {r.sample_strategy for r in a} == {corpus.BY_MONTH} and {r.sample_strategy for r in b} == {corpus.UNLABELLED}
    assert {r.id for r in a} == {r.id for r in b} and len(a) == 30
    months = [sum(r.sample_month == f"2024-{m:02}" for r in a) for m in range(1, 13)]
    assert max(months) - min(m for m in months if m) <= 1
    with pytest.raises(ValueError, match="asked of 2024"):
        corpus.sample_years(df, {2024: 5000}, "date", "id")


def test_positions_by_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i * 3 - 500) for i in rng.sample(range(4000), 4000)]
    df = spark.createDataFrame(rows, "k string, o bigint").repartition(5)
    for keys in ((), ("k",)):
        want: dict = {}
        for k, o in sorted(rows, key=lambda r: r[1]):
            want.setdefault(k if keys else "", []).append(o)
        for size in (100, 10**6):
            got = corpus.positions(df, "o", *keys, rows=size).collect()
            assert len(got) == 4000 and all(want[r.k if keys else ""][r.pos] == r.o for r in got)
    ids = chat.row_ids(df.withColumn("d", F.date_add(F.lit(DAY), F.col("o").cast("int"))), "d").orderBy("o").limit(2).collect()
    assert [r.row_id for r in ids] == ["row_00001", "row_00002"]


def test_loose_exclusion_equals_all_pairs(spark):
    rng = random.Random(6)
    opening = "".join(chr(97 + i * 7 % 26) for i in range(120))
    made = lambda: opening + "".join(rng.choice("xy") for _ in range(rng.choice([0, 1, 3, 30, 39, 40, 41, 80])))
    ours = [(i, "d" if i % 4 else "e", made()) for i in range(120)] + [(500, "d", opening[:119])]
    theirs = [("d" if i % 3 else "e", made()) for i in range(60)] + [("d", opening[:110]), ("d", ours[3][2])]
    left = [r for r in ours if (r[1], r[2]) not in set(theirs)]
    rest = [h for h in theirs if h not in {(d, t) for _, d, t in ours} and len(h[1]) >= 120]

    def near(a, b):
        return a.startswith(b) or b.startswith(a) or (len(a) >= 160 and len(b) >= 160 and a[:160] == b[:160])

    gone = {min(hits) for d, t in rest if (hits := [i for i, day, own in left if day == d and len(own) >= 120 and near(own, t)])}
    got = corpus.exclude_loose(spark.createDataFrame(ours, "id int, date string, text string"), spark.createDataFrame(theirs, "date string, text string"), "id").collect()
    assert gone and {r.id for r in got} == {r[0] for r in left} - gone


def test_a_common_opening_makes_no_pairs(spark):
    opening = "o" * 200
    ours = spark.range(100_000).select("id", F.lit("d").alias("date"), F.concat(F.lit(opening), F.col("id")).alias("text"))
    theirs = spark.range(100_000).select(F.lit("d").alias("date"), F.concat(F.lit(opening + "h"), F.col("id")).alias("text"))
    assert corpus.exclude_loose(ours, theirs, "id").agg(F.count("*"), F.min("id")).first()[:] == (99_999, 1)


def test_sentences_once_each(spark):
    words = ["One two.", "one TWO.", "Three!", "Four?", "three!", "five"]
    body = " ".join(words * 3000)
    df = spark.createDataFrame([(body,), ("Related: x.",), ("related things. y.",), ("",), (None,)], "body string")
    got = [r.body for r in text.distinct_sentences(df, "body").collect()]
    seen, want = set(), []
    import re

    for s in re.split(r"(?<=[.!?])\s+", body):
        if s.lower() not in seen:
            seen.add(s.lower())
            want.append(s)
    assert got[0] == " ".join(want) and got[2] == ""
