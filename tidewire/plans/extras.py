"""Queries on crawled pages, scorers and forecasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import market as M
from ..operators import models as ML
from ..operators import stats as S
from ..operators import suggest as SG
from ..operators import web as W
from . import signals
from .tables import rounded, table
from .texts import _ARTICLES, articles


#: The networks of the queries are as wide and deep as by default, and trained for so many epochs at most.
EPOCHS = 6


def _sequences(spark: SparkSession, d: str, features: tuple[str, ...]) -> DataFrame:
    """Windows of ten trading days with all their features, and the next day's return."""
    df = M.targets(signals.features(spark, d))
    known = df.where(" and ".join(f"{f} is not null" for f in features))
    return M.sequences(M.chronological(known), list(features))


def _errors(forecasts: DataFrame, *keys: str) -> DataFrame:
    return rounded(S.regression_metrics(forecasts, *keys))


def _recurrent(spark, d):
    """ML5, ML6: both recurrent kinds on all 22 features."""
    df = _sequences(spark, d, M.PRICE_FEATURES + M.SENTIMENT_FEATURES)
    return _errors(ML.forecast(df, kinds=("lstm", "gru"), settings=ML.Settings(epochs=EPOCHS)), "ticker", "kind")


def _history(spark, d):
    """Errors by epoch of small networks on the price features."""
    df = _sequences(spark, d, M.PRICE_FEATURES)
    return rounded(ML.history(ML.trained(df, settings=ML.Settings(hidden=16, layers=1, epochs=EPOCHS))))


def _linear(spark, d):
    return _errors(ML.forecast(_sequences(spark, d, M.PRICE_FEATURES), kinds=("linear",)), "ticker")


def _scores(spark, d):
    words = ("ring", "widget", "gear", "red", "small"), ("bolt", "nut", "blue", "large")
    return ML.lexicon_scores(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", *words).select("p_partkey", "label", F.round("prob_positive", 6).alias("prob_positive"))


def _crawl(spark, d):
    pages = table(spark, d, "events").select((F.col("user_id") % 5).alias("site"), F.col("event_id").alias("page"), (F.col("event_type") == "click").alias("fresh"))
    return W.crawl_stop(pages, "site", "page", F.col("fresh"), 12).groupBy("site").agg(F.count("*").alias("n_pages"), F.max("page").alias("last_page"), F.max("stale").alias("stale"))


def _data(spark, d):
    """Each page with its own title and links as the data of a script, from which they are read back."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda x: F.struct(x.alias("url")))
    data = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("page_id").alias("id"), title.alias("title"), links.alias("links"))).alias("stories")).alias("pageProps")).alias("props")))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>")).alias("html"))
    story = W.stories(W.embedded_json("html"))
    return pages.select("page_id", F.get_json_object(story, "$[0].id").alias("story"), F.get_json_object(story, "$[0].title").alias("title"), F.get_json_object(story, "$[0].links[0].url").alias("first_link"))


def _json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _classified(spark, d):
    """Trained on four of five labelled documents, then all are predicted."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    model = ML.text_classifier(labelled.where(F.col("doc_id") % 5 != 0), "text", "quality")
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("predicted"))


def _pairs(spark, d):
    """Every prediction set against every price series, keyed by both, in one plan."""
    scored = signals.scored(spark, d).withColumnRenamed("ticker", "pred_id")
    daily = M.daily_sentiment(M.align(scored, signals.calendar(spark, d), "same_or_next"), "market_date", "pred_id").withColumnRenamed("market_date", "date")
    stock = M.returns(signals.event_prices(spark, d)).withColumnRenamed("ticker", "stock_id")
    joined = daily.join(stock, "date").select("pred_id", "stock_id", F.col("sentiment_score_mean").alias("signal"), F.col("return_tplus0_1d").alias("ret"))
    return rounded(S.lag_metrics(joined, "pred_id", "stock_id"))


def _two_years(spark, d):
    """M4: 100 articles of one year and 200 of the next, each spread over its months, in an order that looks random."""
    a = articles(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    parts = []
    for year, n in ((2023, 100), (2024, 200)):
        own = a.where(F.year("date") == year)
        quota = K.even_quota(own.groupBy("month").agg(F.count("*").alias("size")), "month", "size", n)
        parts.append(K.sample_by_quota(own, quota, "month", K.hashed(year, "doc_id")).select("doc_id", "month", F.lit(year).alias("year")))
    return parts[0].union(parts[1]).groupBy("year", "month").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _prompts(spark, d):
    """A training prompt of each title."""
    head = "Instruction: What is the sentiment of this news? Answer negative, neutral or positive.\nInput: "
    return articles(spark, d).select("doc_id", F.md5(F.concat(F.lit(head), "title", F.lit("\nAnswer: "))).alias("prompt_md5"))


def _suggestions(spark, d):
    """For each customer segment, the three part types of least edit distance (both are small sets of names)."""
    a = table(spark, d, "customer").select("c_mktsegment").distinct()
    b = table(spark, d, "part").select("p_type").distinct()
    near = a.crossJoin(M.lookup(b, 10_000)).withColumn("distance", F.levenshtein(F.lower("c_mktsegment"), F.lower("p_type")))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("distance", "p_type"))
    return near.withColumn("rank", rank).where("rank <= 3").select("c_mktsegment", "p_type", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def _ablation(spark, d):
    """ML8: the same forecasters with the 15 price features and with the 7 of sentiment too, as one frame of metrics."""
    parts = []
    for name, features in (("price_only", M.PRICE_FEATURES), ("price_plus_sentiment", M.PRICE_FEATURES + M.SENTIMENT_FEATURES)):
        made = ML.forecast(_sequences(spark, d, features), kinds=("linear", "gru"), settings=ML.Settings(hidden=16, layers=1, epochs=EPOCHS))
        parts.append(S.regression_metrics(made, "ticker", "kind").withColumn("feature_set", F.lit(name)))
    return rounded(parts[0].unionByName(parts[1]).select("feature_set", "ticker", "kind", "n_rows", "rmse", "r2", "directional_accuracy"))


def _typed(spark, d):
    """Part names like some that are mistyped."""
    wanted = ["smal ring blue", "Rng_large.csv", "boltt nut", "qqqq gear", "widgets red red"]
    return rounded(SG.suggestions(table(spark, d, "part"), "p_name", wanted))


QUERIES = {
    "typed_suggestions": _typed,
    "merged_market": lambda s, d: rounded(signals.merged(s, d).select("ticker", "date", "article_count", "sentiment_score_mean", "close", "return_tplus0_1d", "return_tplus1_1d")),
    "prediction_stock_pairs": _pairs,
    "two_year_sample_counts": _two_years,
    "prompt_render": _prompts,
    "name_suggestions": _suggestions,
    "feature_ablation": _ablation,
    "row_slice": lambda s, d: table(s, d, "events").orderBy("event_id").offset(100).limit(50).select("event_id", "event_type"),
    "date_window_filter": lambda s, d: articles(s, d).where(F.col("date").between("2023-03-01", "2023-12-31")).groupBy("source").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")),
    "text_classifier": _classified,
    "page_links": lambda s, d: W.links(table(s, d, "pages"), "^https?://", ("(?i)the",)),
    "embedded_stories": _data,
    "json_navigation": _json,
    "crawl_stop": _crawl,
    "sitemap_months": lambda s, d: table(s, d, "pages").select("page_id", W.sitemap_month(F.concat(F.lit("http://x/sitemap.2024"), F.lpad((F.col("page_id") % 15).cast("string"), 2, "0"), F.lit(".xml.gz"))).alias("month")),
    "lexicon_scores": _scores,
    "forecast_recurrent": _recurrent,
    "forecast_history": _history,
    "forecast_linear": _linear,
}

_ROOT = r"'^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)'"
_YEARS = [f"SELECT {y} AS year, month, doc_id FROM (SELECT doc_id, month, row_number() OVER (PARTITION BY month ORDER BY md5('{y}|' || doc_id)) AS r FROM am WHERE y = {y}) JOIN (SELECT month, count(*) AS q FROM (SELECT month, row_number() OVER (PARTITION BY month) AS r FROM am WHERE y = {y} ORDER BY r, month LIMIT {n}) GROUP BY month) USING (month) WHERE r <= q" for y, n in ((2023, 100), (2024, 200))]
_PROMPT = "'Instruction: What is the sentiment of this news? Answer negative, neutral or positive.' || chr(10) || 'Input: ' || title || chr(10) || 'Answer: '"
ORACLES = {
    "merged_market": f"WITH {signals._MERGED}, n AS (SELECT ticker, market_date AS date, count(*) AS article_count FROM al GROUP BY ALL) SELECT ticker, date, article_count, round(signal, 6) AS sentiment_score_mean, round(close, 6) AS close, round(r0, 6) AS return_tplus0_1d, round(r1, 6) AS return_tplus1_1d FROM m JOIN n USING (ticker, date) JOIN px USING (ticker, date)",
    "prediction_stock_pairs": f"WITH {signals._MERGED}, j AS (SELECT d.ticker AS pred_id, r.ticker AS stock_id, d.signal, r.r0 AS ret FROM daily d JOIN rets r USING (date) WHERE r.r0 IS NOT NULL) SELECT pred_id, stock_id, count(*) AS n_rows, round({signals._R}, 6) AS pearson_r, round(regr_intercept(ret, signal), 6) AS intercept, round(regr_slope(ret, signal), 6) AS slope, round(regr_r2(ret, signal), 6) AS r2, {signals._DIR} FROM j GROUP BY ALL",
    "two_year_sample_counts": f"WITH {_ARTICLES}, am AS (SELECT doc_id, strftime(date, '%Y-%m') AS month, year(date) AS y FROM articles), a AS ({_YEARS[0]} UNION ALL {_YEARS[1]}) SELECT CAST(year AS INT) AS year, month, count(*) AS n, min(doc_id) AS first_id FROM a GROUP BY ALL",
    "prompt_render": f"WITH {_ARTICLES} SELECT doc_id, md5({_PROMPT}) AS prompt_md5 FROM articles",
    "name_suggestions": "WITH x AS (SELECT c_mktsegment, p_type, levenshtein(lower(c_mktsegment), lower(p_type)) AS distance FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT p_type FROM part)), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY distance, p_type) AS rank FROM x) SELECT * FROM r WHERE rank <= 3",
    "row_slice": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 100",
    "date_window_filter": f"WITH {_ARTICLES} SELECT source, count(*) AS n, min(date) AS first, max(date) AS last FROM articles WHERE date BETWEEN DATE '2023-03-01' AND DATE '2023-12-31' GROUP BY source",
    "page_links": f"SELECT page_id, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, {_ROOT}, 1) || h ELSE h END AS link FROM (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"''#]+)', 1))) AS h FROM pages) WHERE NOT regexp_matches(regexp_extract(url, {_ROOT}, 1) || h, '(?i)the')",
    "embedded_stories": """SELECT page_id, CAST(page_id AS VARCHAR) AS story, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] AS first_link FROM pages""",
    "json_navigation": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "crawl_stop": "WITH p AS (SELECT user_id % 5 AS site, event_id AS page, event_type = 'click' AS fresh FROM events), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY site ORDER BY page) AS run FROM p), s AS (SELECT *, CAST(sum((NOT fresh)::INT) OVER (PARTITION BY site, run ORDER BY page) AS BIGINT) AS stale FROM r), st AS (SELECT site, min(page) AS stop FROM s WHERE stale >= 12 GROUP BY site) SELECT site, count(*) AS n_pages, max(page) AS last_page, max(stale) AS stale FROM s LEFT JOIN st USING (site) WHERE stop IS NULL OR page <= stop GROUP BY site",
    "sitemap_months": "SELECT page_id, CAST(try_strptime('2024' || lpad(CAST(page_id % 15 AS VARCHAR), 2, '0') || '01', '%Y%m%d') AS DATE) AS month FROM pages",
    "lexicon_scores": "WITH c AS (SELECT p_partkey, len(regexp_extract_all(lower(p_name), '\\b(?:ring|widget|gear|red|small)\\b')) AS p, len(regexp_extract_all(lower(p_name), '\\b(?:bolt|nut|blue|large)\\b')) AS n FROM part), s AS (SELECT p_partkey, exp(p) / (exp(p) + exp(n) + exp(0.5)) AS pp, exp(n) / (exp(p) + exp(n) + exp(0.5)) AS pn, exp(0.5) / (exp(p) + exp(n) + exp(0.5)) AS pu FROM c) SELECT p_partkey, CASE WHEN pu >= pp AND pu >= pn THEN 'neutral' WHEN pn >= pp THEN 'negative' ELSE 'positive' END AS label, round(pp, 6) AS prob_positive FROM s",
}
