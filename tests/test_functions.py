"""Text, dates, labels and names, by hand-derived rows."""

from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, labels, resolve, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.com//a//b/?utm_source=x&b=2#frag", "https://example.com/a/b?b=2"),
        ("example.com/x#y", "example.com/x"),
        ("http://a.com/?UTM_Medium=1&q=a%20b&c", "http://a.com?q=a+b&c="),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, text.canonical_url) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("KUALA LUMPUR: Up.", "Up."), ("home | KUALA LUMPUR (Jan 31): Up.", "Up."), ("TOKYO (Reuters) - Up.", "Up."), ("ALOR SETAR, Jan 1 — Up.", "Up."), ("Up: down.", "Up: down.")],
)
def test_datelines(spark, value, want):
    assert text.strip_dateline(spark.createDataFrame([(value,)], "x string"), "x").first().x == want


@pytest.mark.parametrize(("value", "want"), [("NEW YORK\nUSA, JAN 1 (Reuters) - Up.", "Up."), ("ABC\nDE: Up.", "ABC\nDE: Up."), ("\n".join(["ABC"] * 6) + ": Up.", "Up."), ("\n".join(["ABC"] * 7) + ": Up.", "\n".join(["ABC"] * 7) + ": Up.")])
def test_datelines_over_lines(spark, value, want):
    assert text.strip_dateline(spark.createDataFrame([(value,)], "x string"), "x").first().x == want


def test_datelines_of_long_heads_take_no_time(spark):
    heads = ["abc  " * 40, "ABC DEF, " * 20, "the market rose again today while others fell " * 4]
    start = time.monotonic()
    assert [r.x for r in text.strip_dateline(spark.createDataFrame([(h + "1",) for h in heads * 10], "x string"), "x").collect()] == [h + "1" for h in heads * 10]
    assert time.monotonic() - start < 20


@pytest.mark.parametrize(("value", "want"), [("Up today. up today. Down!", "Up today. Down!"), ("Related stories: x", ""), ("Relatedly. x", "Relatedly. x"), (None, "")])
def test_sentences(spark, value, want):
    assert text.distinct_sentences(spark.createDataFrame([(value,)], "x string"), "x").first().x == want


def test_mojibake():
    assert text.repaired("cafÃ©") == "café" and text.repaired("plain Â") == "plain Â"
    assert text.repaired("cafÃƒÂ©") == "café"


def test_mojibake_columns(spark):
    odd = [None, "", "plain", "cafÃ©", "cafÃƒÂ©", "itâ€™s", "itâ€™s \x92Ã©", "日 Ã©", "â€\x9d", "â\x80\x9d", "Ã", "Ã\x81", "Ã©\x00", "ðŸ˜€ Ã©", "Â£ ÿ", "À\xaf Ã©", "í\xa0\x80 Ã©", "ÃƒÆ’Ã‚Â©"] + [f"Ã{chr(i)}" for i in range(0x80, 0x200)]
    frame = text.repair(spark.createDataFrame(list(enumerate(odd)), "i int, x string"), "x")
    assert {r.i: r.x for r in frame.collect()} == {i: x and text.repaired(x) for i, x in enumerate(odd)}
    assert "Python" not in frame._jdf.queryExecution().toString()


def test_white_space(spark):
    assert one(spark, " a  b\x1c\n", text.collapse) == "a b"


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (labels.corpus, "pos/neg", "negative"),
        (labels.gold, "Bullish", "positive"),
        (labels.gold, "-1", "negative"),
        (labels.gold, "mixed", "neutral"),
        (labels.gold, "n/a", ""),
        (labels.generated, "Not positive, negative", "positive"),
        (labels.generated, "", "neutral"),
        (labels.chat, '{"label":"positive"}', "pos"),
        (labels.chat, None, ""),
        (labels.training, "bearish", 0),
    ],
)
def test_labels(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_unknown_training_label(spark):
    with pytest.raises(Exception, match="unknown label"):
        one(spark, "what", labels.training)


@pytest.mark.parametrize(("value", "want"), [("03/04/2025", (2025, 4, 3)), ("31/12/24", (2024, 12, 31)), ("12/31/2024", (2024, 12, 31)), ("2024-02-30", None), ("soon", None)])
def test_dates(spark, value, want):
    assert one(spark, value, dates.parsed) == (want and datetime.date(*want))


def test_windows(spark):
    days = [datetime.date(2023, 1, 1), datetime.date(2023, 1, 2), datetime.date(2023, 4, 1), datetime.date(2023, 9, 30), None]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    got = [tuple(map(str, r[:2])) + (r.n_rows,) for r in dates.tumbling(df, "day", 90).orderBy("window_start").collect()]
    assert got == [("2023-01-01", "2023-03-31", 2), ("2023-04-01", "2023-06-29", 1), ("2023-06-30", "2023-09-27", 0), ("2023-09-28", "2023-09-30", 1)]
    assert dates.tumbling(df.where("day is null"), "day", 90).collect() == []


def test_names(spark):
    assert resolve.exact(["Date", "TEXT"], ["text", "date"]) == "TEXT"
    assert resolve.fuzzy(["Adj Close", "Close"], ["adj close", "close"]) == "Adj Close"
    assert resolve.fuzzy(["x_close_y"], ["close"]) == "x_close_y"
    assert resolve.flat_headers(spark.createDataFrame([(1, 2)], "`a ` int, b int")).columns == ["a", "b"]
    assert resolve.safe_name("1155.KL") == "1155" and resolve.slug("CIMB Group Holdings") == "cimb_group_holdings"
    assert resolve.lags(["2,0", "1"]) == [0, 1, 2]
    assert resolve.label_column(["x", "finbert_label"]) == "finbert_label"
    assert resolve.sentiment_columns(["my_Sentiment", "label", "finbert_label"]) == ["my_Sentiment", "finbert_label"]
    with pytest.raises(ValueError):
        resolve.lags(["-1"])


def test_clean_runs_python_once(spark):
    frame = text.clean(spark.createDataFrame([("a &amp; <b>b</b> cafÃ©",), (None,)], "x string"), "x")
    assert [r.x for r in frame.collect()] == ["a & b café", ""]
    assert frame.select(F.col("x"))._jdf.queryExecution().toString().count("ArrowEvalPython") <= 8
