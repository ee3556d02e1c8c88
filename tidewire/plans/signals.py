"""Queries on daily signals and prices. Articles are the events, trading days their weekdays, prices the lines by ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import stats as S
from .tables import rounded, table

LAGS = (0, 1, 2)


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    score = F.when(F.col("event_type").isin("purchase", "click"), 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return e.select("event_id", F.to_date("ts").alias("calendar_date"), score.alias("score"), (F.col("user_id") % 4).alias("ticker"), "ts", "value")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.to_date("ts").alias("market_date")).distinct()
    return days.where(F.dayofweek("market_date").between(2, 6))


def _aligned(mode: str):
    return lambda spark, d: rounded(M.daily_sentiment(M.align(scored(spark, d), calendar(spark, d), mode), "market_date"))


def event_prices(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where(F.dayofweek("calendar_date").between(2, 6))
    return s.groupBy("ticker", F.col("calendar_date").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Daily sentiment by ticker, aligned to trading days, with the returns of the same day and later ones."""
    daily = M.daily_sentiment(M.align(scored(spark, d), calendar(spark, d), "same_or_next"), "market_date", "ticker").withColumnRenamed("market_date", "date")
    return daily.join(M.returns(event_prices(spark, d), LAGS), ["ticker", "date"])


def _by_lag(df: DataFrame) -> DataFrame:
    return df.select("ticker", "date", F.col("sentiment_score_mean").alias("signal"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"return_tplus{k}_1d").alias("ret")) for k in LAGS])).alias("r")).select("ticker", "date", "signal", "r.lag", "r.ret")


def lag_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.lag_metrics(_by_lag(merged(spark, d)), "ticker", "lag"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return M.bars(table(spark, d, "lineitem"), F.to_date("l_shipdate"), F.col("l_suppkey") % 4)


def _ema(spark, d):
    df = M.smoothed(prices(spark, d), {f"e{n}": ("close", M.span(n)) for n in (5, 10, 12, 26)})
    return rounded(df.select("ticker", "date", *[(M.ratio(F.col("close"), F.col(f"e{n}")) - 1).alias(f"ema_gap_{n}") for n in (5, 10, 12, 26)]))


def _macd(spark, d):
    return rounded(M.macd(prices(spark, d)).select("ticker", "date", "macd", F.col("macd_signal").alias("signal"), F.col("macd_hist").alias("hist")))


def opinions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scored articles, on the dates that prices have: urgent ones are bad news, low ones good."""
    score = F.when(F.col("o_orderpriority") == "1-URGENT", -1.0).when(F.col("o_orderpriority") == "5-LOW", 1.0).otherwise(0.0)
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("calendar_date"), score.alias("score"), (F.col("o_custkey") % 4).alias("ticker"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each ticker with the 15 price features and, by trading day, the 7 of sentiment."""
    bars = prices(spark, d)
    daily = M.daily_sentiment(M.align(opinions(spark, d), bars.select(F.col("date").alias("market_date")).distinct(), "same_or_next"), "market_date", "ticker").withColumnRenamed("market_date", "date")
    return M.engineered(bars.join(daily.drop("first_calendar_date", "last_calendar_date"), ["ticker", "date"]))


def _split(spark, d):
    return M.chronological(prices(spark, d).withColumn("ret", M.change("close", M.series("ticker"))))


def _targets(spark, d):
    w = M.series("ticker")
    return prices(spark, d).select("ticker", "date", "close", F.lead("date", 1).over(w).alias("target_date"), (M.ratio(F.lead("close", 1).over(w), F.col("close")) - 1).alias("target"))


def _horizons(spark, d):
    """Both kinds of target, 1, 5 and 20 rows ahead."""
    parts = [M.targets(prices(spark, d), h, mode).select("ticker", "date", F.lit(h).alias("horizon"), F.lit(mode).alias("mode"), "target_date", "target") for h in (1, 5, 20) for mode in ("next_close", "next_return")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _price_errors(spark, d):
    """Next close foretold as this close plus its last move."""
    w = M.series("ticker")
    df = prices(spark, d).select("ticker", "close", (2 * F.col("close") - F.lag("close").over(w)).alias("predicted"), F.lead("close").over(w).alias("actual"))
    return rounded(S.regression_metrics(df.where("actual is not null and predicted is not null"), "ticker", current="close"))


def _persistence(spark, d):
    """This close as forecast of the next: no move is foretold, so no direction counts."""
    df = prices(spark, d).select("ticker", "close", F.col("close").alias("predicted"), F.lead("close").over(M.series("ticker")).alias("actual")).where("actual is not null")
    return rounded(S.regression_metrics(df, "ticker", current="close").drop("directional_accuracy"))


def _regression(spark, d):
    w = M.series("ticker")
    df = prices(spark, d).withColumn("actual", M.change("close", w)).withColumn("predicted", F.lag("actual").over(w)).where("actual is not null and predicted is not null")
    return rounded(S.regression_metrics(df, "ticker"))


def _scaled(spark, d):
    df = M.scaled(_split(spark, d), ["close", "volume"])
    return rounded(df.select("ticker", "date", "close_z", "volume_z"))


def _sequences(spark, d):
    df = M.sequences(_split(spark, d), ["close", "volume"])
    flat = F.flatten("steps")
    return rounded(df.select("ticker", "date", "split", F.size("steps").alias("n_steps"), F.element_at(flat, 1).alias("first_close"), F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total")), 2)


def _granger(spark, d):
    df = prices(spark, d)
    w = M.series("ticker")
    return S.granger(df.select("ticker", "date", M.change("volume", w).alias("signal"), M.change("close", w).alias("ret")))


def _article_summary(spark, d):
    daily = M.daily_sentiment(scored(spark, d), "calendar_date")
    return rounded(daily.agg(F.avg("article_count").alias("mean"), F.median("article_count").cast("double").alias("median"), F.min("article_count").alias("min"), F.max("article_count").alias("max")))


def _heatmap(spark, d):
    both = S.lag_metrics(_by_lag(merged(spark, d)), "ticker", "lag").join(S.spearman(_by_lag(merged(spark, d)), "ticker", "lag").drop("n_rows"), ["ticker", "lag"])
    return rounded(both.unpivot(["ticker", "lag"], ["pearson_r", "spearman_r", "directional_accuracy"], "metric", "value"))


QUERIES = {
    "daily_sentiment_calendar": lambda s, d: rounded(M.daily_sentiment(scored(s, d).withColumn("day", F.col("calendar_date")), "day")),
    "daily_sentiment_market_same_day": _aligned("same_day"),
    "daily_sentiment_market_asof": _aligned("same_or_next"),
    "daily_sentiment_market_next_day": _aligned("next_only"),
    "min_articles_having": lambda s, d: rounded(M.daily_sentiment(scored(s, d).withColumn("day", F.col("calendar_date")), "day").where("article_count >= 340").select("day", "article_count", "sentiment_score_mean")),
    "article_count_summary": _article_summary,
    "returns_lead_lag": lambda s, d: rounded(M.returns(prices(s, d), LAGS).select("ticker", "date", "close", *[f"return_tplus{k}_1d" for k in LAGS])),
    "lag_metrics_pearson_ols": lag_metrics,
    "lag_metrics_spearman": lambda s, d: rounded(S.spearman(_by_lag(merged(s, d)), "ticker", "lag")),
    "directional_accuracy": lambda s, d: rounded(S.lag_metrics(_by_lag(merged(s, d)), "lag").select("lag", "n_rows", "directional_accuracy", "directional_coverage")),
    "lag_p_values": lambda s, d: rounded(S.with_p(S.lag_metrics(_by_lag(merged(s, d)), "ticker", "lag")).select("ticker", "lag", "n_rows", "pearson_r", "p_value")),
    "lag_metrics_full": lambda s, d: rounded(S.full_metrics(_by_lag(merged(s, d)), "ticker", "lag")),
    "lag_heatmap": _heatmap,
    "granger_f_stats": lambda s, d: rounded(_granger(s, d)),
    "granger_best_lag": lambda s, d: rounded(S.granger_best(_granger(s, d))),
    "ohlcv_daily": prices,
    "sma_gaps": lambda s, d: rounded(prices(s, d).select("ticker", "date", M.sma_gap(5).alias("sma_gap_5"), M.sma_gap(10).alias("sma_gap_10"))),
    "rolling_volatility": lambda s, d: rounded(prices(s, d).withColumn("ret", M.change("close", M.series("ticker"))).select("ticker", "date", M.volatility(F.col("ret"), 5).alias("vol_5"), M.volatility(F.col("ret"), 10).alias("vol_10"))),
    "ema_gaps": _ema,
    "rsi_14": lambda s, d: rounded(M.rsi(prices(s, d)).select("ticker", "date", "rsi")),
    "engineered_features": lambda s, d: rounded(features(s, d).select("ticker", "date", *M.PRICE_FEATURES, *M.SENTIMENT_FEATURES)),
    "targets_by_horizon": lambda s, d: rounded(_horizons(s, d)),
    "macd": _macd,
    "volume_features": lambda s, d: rounded(prices(s, d).select("ticker", "date", F.log1p(F.greatest("volume", F.lit(0.0))).alias("volume_log"), M.change("volume", M.series("ticker")).alias("volume_change"))),
    "intraday_ratios": lambda s, d: rounded(prices(s, d).select("ticker", "date", M.ratio(F.col("close") - F.col("open"), F.col("open")).alias("open_close_pct"), M.ratio(F.col("high") - F.col("low"), F.col("close")).alias("high_low_pct"))),
    "log_returns": lambda s, d: rounded(prices(s, d).select("ticker", "date", (F.ln("close") - F.lag(F.ln("close")).over(M.series("ticker"))).alias("log_return"))),
    "targets_next_return": lambda s, d: rounded(_targets(s, d)),
    "chronological_split": lambda s, d: _split(s, d).groupBy("ticker", "n", "train_end", "val_end", "split").agg(F.count("*").alias("n_sequences")),
    "train_scaled_features": _scaled,
    "sequence_windows": _sequences,
    "persistence_metrics": _persistence,
    "price_error_metrics": _price_errors,
    "regression_metrics": _regression,
    "normalized_close": lambda s, d: rounded(prices(s, d).select("ticker", "date", (F.col("close") / F.first("close").over(M.series("ticker"))).alias("normalized_close"))),
}

_SCORED = "scored AS (SELECT event_id, CAST(ts AS DATE) AS calendar_date, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 WHEN event_type = 'error' THEN -1.0 ELSE 0.0 END::DOUBLE AS score, user_id % 4 AS ticker, ts, value FROM events)"
_CALENDAR = "cal AS (SELECT DISTINCT CAST(ts AS DATE) AS market_date FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)"
_DAILY = "count(*) AS article_count, round(avg(score), 6) AS sentiment_score_mean, round(coalesce(stddev_samp(score), 0), 6) AS sentiment_score_std, round(avg((score > 0)::INT), 6) AS positive_ratio, round(avg((score < 0)::INT), 6) AS negative_ratio, round(avg((score = 0)::INT), 6) AS neutral_ratio, count(DISTINCT calendar_date) AS source_day_count, min(calendar_date) AS first_calendar_date, max(calendar_date) AS last_calendar_date"
_MERGED = f"""{_SCORED}, {_CALENDAR},
al AS (SELECT s.*, c.market_date FROM scored s ASOF JOIN cal c ON s.calendar_date <= c.market_date),
daily AS (SELECT ticker, market_date AS date, avg(score) AS signal FROM al GROUP BY ALL),
px AS (SELECT ticker, calendar_date AS date, last(value ORDER BY ts, event_id) AS close FROM scored WHERE dayofweek(calendar_date) BETWEEN 1 AND 5 GROUP BY ALL),
r0 AS (SELECT ticker, date, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rets AS (SELECT ticker, date, r AS r0, lead(r, 1) OVER w AS r1, lead(r, 2) OVER w AS r2 FROM r0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
m AS (SELECT * FROM daily JOIN rets USING (ticker, date)),
pairs AS (SELECT * FROM (SELECT ticker, date, signal, 0 AS lag, r0 AS ret FROM m UNION ALL SELECT ticker, date, signal, 1, r1 FROM m UNION ALL SELECT ticker, date, signal, 2, r2 FROM m) WHERE signal IS NOT NULL AND ret IS NOT NULL)"""
_DIR = "round(avg(CASE WHEN sign(signal) * sign(ret) <> 0 THEN (sign(signal) = sign(ret))::INT END), 6) AS directional_accuracy, round(avg((sign(signal) * sign(ret) <> 0)::INT), 6) AS directional_coverage"
_R = "covar_pop(signal, ret) / nullif(stddev_pop(signal) * stddev_pop(ret), 0)"
_LAGGED = f"""lm AS (SELECT ticker, lag, count(*) AS n_rows, round({_R}, 6) AS pearson_r, round(regr_intercept(ret, signal), 6) AS intercept, round(regr_slope(ret, signal), 6) AS slope, round(regr_r2(ret, signal), 6) AS r2, {_DIR} FROM pairs GROUP BY ticker, lag)"""
_RANKED = """ranked AS (SELECT ticker, lag, rank() OVER (PARTITION BY ticker, lag ORDER BY signal) + (count(*) OVER (PARTITION BY ticker, lag, signal) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY ticker, lag ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, lag, ret) - 1) / 2.0 AS rr FROM pairs),
sp AS (SELECT ticker, lag, count(*) AS n_rows, round(covar_pop(rs, rr) / nullif(stddev_pop(rs) * stddev_pop(rr), 0), 6) AS spearman_r FROM ranked GROUP BY ALL)"""


def _bars(day: str) -> str:
    o = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    return f"px AS (SELECT l_suppkey % 4 AS ticker, {day} AS date, first(l_extendedprice ORDER BY {o}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {o}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"


_PX = _bars("CAST(l_shipdate AS DATE)")
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_RETS = f"rt AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM px {_W})"
_SPLIT = f"""{_PX}, {_RETS}, b AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM rt {_W}),
c AS (SELECT *, CAST(greatest(floor(n * 0.70), 15) AS BIGINT) AS train_end FROM b WHERE n >= 80),
e AS (SELECT *, CAST(least(greatest(floor(n * 0.85), train_end + 5), n - 5) AS BIGINT) AS val_end FROM c),
sp AS (SELECT *, CASE WHEN pos < 9 THEN NULL WHEN pos < train_end THEN 'train' WHEN pos < val_end THEN 'val' ELSE 'test' END AS split FROM e)"""


def _recursive(name: str, source: str, value: str, alphas: dict[str, float], extra: str = "") -> str:
    """A recursive CTE of exponential means over ``source`` (ticker, rn, value)."""
    first = ", ".join(f"{value}::DOUBLE AS {n}" for n in alphas)
    more = ", ".join(f"{a!r} * s.{value} + {1 - a!r} * r.{n}" for n, a in alphas.items())
    return f"{name} AS (SELECT ticker, rn, {first} FROM {source} WHERE rn = 1 UNION ALL SELECT s.ticker, s.rn, {more} FROM {name} r JOIN {source} s ON s.ticker = r.ticker AND s.rn = r.rn + 1)"


def _p_value(r: str) -> str:
    """SQL: Student's t in closed form for whole degrees of freedom v = n - 2, where the angle's sine is |r|."""
    return f"""CASE WHEN n_rows % 2 = 0
THEN 1 - abs({r}) * list_sum(list_transform(range(0, (n_rows - 2) // 2), lambda k: pow(1 - {r} * {r}, k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi())))
ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * list_sum(list_transform(range(0, (n_rows - 3) // 2), lambda k: pow(1 - {r} * {r}, k + 0.5) * sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5))))) END"""


def _granger_sql(maxlag: int = 3) -> str:
    """SQL: both directions by lag. Own lags, then the other's, are taken out of the covariances one by one; what is left of y
    is the variance of its residuals. F's tail comes from Student's by the recurrence of the incomplete beta function."""
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in "yx" for k in range(1, maxlag + 1))
    parts = [f"v AS (SELECT ticker, date, volume / nullif(lag(volume) OVER w, 0) - 1 AS s, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM px {_W})"]
    parts.append("d AS (SELECT ticker, date, 'sentiment_to_return' AS direction, r AS y, s AS x FROM v WHERE s IS NOT NULL AND r IS NOT NULL UNION ALL SELECT ticker, date, 'return_to_sentiment', s, r FROM v WHERE s IS NOT NULL AND r IS NOT NULL)")
    parts.append(f"g AS (SELECT *, count(*) OVER (PARTITION BY ticker, direction) AS n, {lags} FROM d WINDOW w AS (PARTITION BY ticker, direction ORDER BY date))")
    ends = []
    for k in range(1, maxlag + 1):
        names = ["y", *[f"y{i}" for i in range(1, k + 1)], *[f"x{i}" for i in range(1, k + 1)]]
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        parts.append(f"c{k}_0 AS (SELECT ticker, direction, count(*) AS m, any_value(n) AS n, " + ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for a, b in pairs) + f" FROM g WHERE y{k} IS NOT NULL GROUP BY ticker, direction)")
        for step, out in enumerate(names[1:], 1):
            left = ["y", *names[step + 1 :]]
            at = lambda a, b, order=names: f"{a}_{b}" if order.index(a) <= order.index(b) else f"{b}_{a}"
            rest = [f"{a}_{b} - {at(a, out)} * {at(b, out)} / {out}_{out} AS {a}_{b}" for i, a in enumerate(left) for b in left[i:]]
            few = ", y_y AS few" if step == k + 1 else ", few" if step > k + 1 else ""
            parts.append(f"c{k}_{step} AS (SELECT ticker, direction, m, n{few}, {', '.join(rest)} FROM c{k}_{step - 1})")
        ends.append(f"SELECT ticker, direction, CAST({k} AS BIGINT) AS lag, n, (few - y_y) / {k} / (y_y / (m - {2 * k + 1})) AS f, m - {2 * k + 1} AS df FROM c{k}_{2 * k}")
    parts.append("f AS (SELECT * FROM (" + " UNION ALL ".join(ends) + f") WHERE n >= {max(30, 8 * maxlag)} AND df > 0)")
    parts.append("t AS (SELECT *, df + 2 AS n_rows, df / (df + lag * f) AS z, sqrt(1 - df / (df + lag * f)) AS sn FROM f)")
    tail = _p_value("sn")
    beta = "exp(lgamma(df / 2.0) + lgamma(0.5) - lgamma(df / 2.0 + 0.5))"
    parts.append(f"gr AS (SELECT ticker, direction, lag, f AS f_stat, CASE lag WHEN 1 THEN {tail} WHEN 2 THEN pow(z, df / 2.0) ELSE {tail} + pow(z, df / 2.0) * sn / (0.5 * {beta}) END AS p_value, CAST(df AS BIGINT) AS df_denom, lag AS df_num FROM t)")
    return ", ".join(parts)


_NUMBERED = f"nm AS (SELECT *, row_number() OVER w AS rn FROM px {_W})"
_MACD = f"{_recursive('e2', 'nm', 'close', {'e12': 2 / 13, 'e26': 2 / 27})}, mc AS (SELECT ticker, rn, e12 - e26 AS macd FROM e2), {_recursive('sg', 'mc', 'macd', {'sig': 2 / 10})}"
_RSI = f"dl AS (SELECT ticker, date, close - lag(close) OVER w AS delta FROM px {_W}), gl AS (SELECT ticker, date, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss, row_number() OVER w AS rn FROM dl WHERE delta IS NOT NULL {_W}), {_recursive('ag', 'gl', 'gain', {'g': 1 / 14})}, {_recursive('ls', 'gl', 'loss', {'l': 1 / 14})}, rs AS (SELECT px.ticker, px.date, CASE WHEN rn IS NULL OR rn < 14 OR l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END::DOUBLE AS rsi FROM px LEFT JOIN (SELECT gl.ticker, gl.date, rn, g, l FROM gl JOIN ag USING (ticker, rn) JOIN ls USING (ticker, rn)) x USING (ticker, date))"
_BARS = _PX.replace("px AS", "bars AS", 1)
_CAL = "cal AS (SELECT DISTINCT date AS market_date FROM bars)"
_OPINIONS = f"sc AS (SELECT CAST(o_orderdate AS DATE) AS calendar_date, CASE o_orderpriority WHEN '1-URGENT' THEN -1.0 WHEN '5-LOW' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, o_custkey % 4 AS ticker FROM orders), op AS (SELECT ticker, market_date AS date, {_DAILY} FROM sc ASOF JOIN cal ON calendar_date <= market_date GROUP BY ticker, market_date)"
_ERR = "count(*) AS n_rows, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(actual), 0), 6) AS r2, round(avg(CASE WHEN sign(actual) * sign(predicted) <> 0 THEN (sign(actual) = sign(predicted))::INT END), 6) AS directional_accuracy, round(avg((sign(actual) * sign(predicted) <> 0)::INT), 6) AS directional_coverage"
_PRICE_ERR = "count(*) AS n_rows, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(100 * avg(CASE WHEN abs(actual) > 1e-8 THEN abs((actual - predicted) / actual) END), 6) AS mape, round(1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(actual), 0), 6) AS r2"

ORACLES = {
    "daily_sentiment_calendar": f"WITH {_SCORED} SELECT calendar_date AS day, {_DAILY} FROM scored GROUP BY calendar_date",
    "daily_sentiment_market_same_day": f"WITH {_SCORED}, {_CALENDAR} SELECT market_date, {_DAILY} FROM scored JOIN cal ON calendar_date = market_date GROUP BY market_date",
    "daily_sentiment_market_asof": f"WITH {_SCORED}, {_CALENDAR} SELECT market_date, {_DAILY} FROM scored ASOF JOIN cal ON calendar_date <= market_date GROUP BY market_date",
    "daily_sentiment_market_next_day": f"WITH {_SCORED}, {_CALENDAR} SELECT market_date, {_DAILY} FROM scored ASOF JOIN cal ON calendar_date < market_date GROUP BY market_date",
    "min_articles_having": f"WITH {_SCORED} SELECT calendar_date AS day, count(*) AS article_count, round(avg(score), 6) AS sentiment_score_mean FROM scored GROUP BY 1 HAVING count(*) >= 340",
    "article_count_summary": f"WITH {_SCORED}, d AS (SELECT count(*) AS c FROM scored GROUP BY calendar_date) SELECT round(avg(c), 6) AS mean, round(median(c)::DOUBLE, 6) AS median, min(c) AS min, max(c) AS max FROM d",
    "returns_lead_lag": f"WITH {_PX}, {_RETS} SELECT ticker, date, round(close, 6) AS close, round(ret, 6) AS return_tplus0_1d, round(lead(ret, 1) OVER w, 6) AS return_tplus1_1d, round(lead(ret, 2) OVER w, 6) AS return_tplus2_1d FROM rt {_W}",
    "lag_metrics_pearson_ols": f"WITH {_MERGED}, {_LAGGED} SELECT * FROM lm",
    "lag_p_values": f"""WITH {_MERGED}, c AS (SELECT ticker, lag, count(*) AS n_rows, CASE WHEN count(*) >= 5 THEN {_R} END AS r FROM pairs GROUP BY ticker, lag)
SELECT ticker, lag, n_rows, round(r, 6) AS pearson_r, round({_p_value('r')}, 6) AS p_value FROM c""",
    "lag_metrics_full": f"""WITH {_MERGED}, {_LAGGED}, {_RANKED.replace('round(covar_pop(rs, rr) / nullif(stddev_pop(rs) * stddev_pop(rr), 0), 6)', 'covar_pop(rs, rr) / nullif(stddev_pop(rs) * stddev_pop(rr), 0)')}, c AS (SELECT ticker, lag, {_R} AS r FROM pairs GROUP BY ticker, lag)
SELECT lm.*, round(spearman_r, 6) AS spearman_r, round({_p_value('r')}, 6) AS pearson_p, round({_p_value('spearman_r')}, 6) AS spearman_p, round({_p_value('r')}, 6) AS slope_p FROM lm JOIN c USING (ticker, lag) JOIN (SELECT ticker, lag, spearman_r FROM sp) USING (ticker, lag)""",
    "granger_f_stats": f"WITH {_PX}, {_granger_sql()} SELECT ticker, direction, lag, round(f_stat, 6) AS f_stat, round(p_value, 6) AS p_value, df_denom, df_num FROM gr",
    "granger_best_lag": f"WITH {_PX}, {_granger_sql()}, b AS (SELECT ticker, direction, arg_min(lag, [p_value, lag]) AS best_lag, min(p_value) AS best_p FROM gr GROUP BY ALL) SELECT ticker, direction, best_lag, round(best_p, 6) AS best_p_value, best_p < 0.05 AS significant FROM b",
    "lag_metrics_spearman": f"WITH {_MERGED}, {_RANKED} SELECT * FROM sp",
    "directional_accuracy": f"WITH {_MERGED} SELECT lag, count(*) AS n_rows, {_DIR} FROM pairs GROUP BY lag",
    "lag_heatmap": f"WITH {_MERGED}, {_LAGGED}, {_RANKED}, j AS (SELECT ticker, lag, pearson_r, spearman_r, directional_accuracy FROM lm JOIN sp USING (ticker, lag)) SELECT ticker, lag, 'pearson_r' AS metric, pearson_r AS value FROM j UNION ALL SELECT ticker, lag, 'spearman_r', spearman_r FROM j UNION ALL SELECT ticker, lag, 'directional_accuracy', directional_accuracy FROM j",
    "ohlcv_daily": f"WITH {_PX} SELECT * FROM px",
    "sma_gaps": f"WITH {_PX} SELECT ticker, date, round(CASE WHEN count(*) OVER w5 = 5 THEN close / avg(close) OVER w5 - 1 END, 6) AS sma_gap_5, round(CASE WHEN count(*) OVER w10 = 10 THEN close / avg(close) OVER w10 - 1 END, 6) AS sma_gap_10 FROM px WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)",
    "rolling_volatility": f"WITH {_PX}, {_RETS} SELECT ticker, date, round(CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END, 6) AS vol_5, round(CASE WHEN count(ret) OVER w10 = 10 THEN stddev_samp(ret) OVER w10 END, 6) AS vol_10 FROM rt WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)",
    "ema_gaps": f"WITH RECURSIVE {_PX}, {_NUMBERED}, {_recursive('em', 'nm', 'close', {'e5': 2 / 6, 'e10': 2 / 11, 'e12': 2 / 13, 'e26': 2 / 27})} SELECT ticker, date, round(close / e5 - 1, 6) AS ema_gap_5, round(close / e10 - 1, 6) AS ema_gap_10, round(close / e12 - 1, 6) AS ema_gap_12, round(close / e26 - 1, 6) AS ema_gap_26 FROM em JOIN nm USING (ticker, rn)",
    "macd": f"WITH RECURSIVE {_PX}, {_NUMBERED}, {_MACD} SELECT ticker, date, round(macd, 6) AS macd, round(sig, 6) AS signal, round(macd - sig, 6) AS hist FROM nm JOIN mc USING (ticker, rn) JOIN sg USING (ticker, rn)",
    "rsi_14": f"WITH RECURSIVE {_PX}, {_RSI} SELECT ticker, date, round(rsi, 6) AS rsi FROM rs",
    "engineered_features": f"""WITH RECURSIVE {_BARS}, {_CAL}, {_OPINIONS}, px AS (SELECT b.*, o.* EXCLUDE (ticker, date) FROM bars b JOIN op o USING (ticker, date)), {_NUMBERED}, {_RETS}, {_recursive('em', 'nm', 'close', {'e5': 2 / 6, 'e10': 2 / 11})}, {_MACD}, {_RSI}
SELECT ticker, date, round(close, 6) AS close, round(ret, 6) AS return_1d, round(ln(close) - lag(ln(close)) OVER w, 6) AS log_return_1d, round(ln(1 + greatest(volume, 0)), 6) AS volume_log1p, round(volume / nullif(lag(volume) OVER w, 0) - 1, 6) AS volume_change_1d,
round(CASE WHEN count(*) OVER w5 = 5 THEN close / avg(close) OVER w5 - 1 END, 6) AS sma_5_gap, round(CASE WHEN count(*) OVER w10 = 10 THEN close / avg(close) OVER w10 - 1 END, 6) AS sma_10_gap, round(close / e5 - 1, 6) AS ema_5_gap, round(close / e10 - 1, 6) AS ema_10_gap,
round(CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END, 6) AS volatility_5, round(CASE WHEN count(ret) OVER w10 = 10 THEN stddev_samp(ret) OVER w10 END, 6) AS volatility_10, round(rsi, 6) AS rsi_14, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_hist,
sentiment_score_mean, sentiment_score_std, round(ln(1 + article_count), 6) AS article_count_log1p, positive_ratio, negative_ratio, neutral_ratio, source_day_count
FROM nm JOIN (SELECT ticker, date, ret FROM rt) USING (ticker, date) JOIN em USING (ticker, rn) JOIN mc USING (ticker, rn) JOIN sg USING (ticker, rn) JOIN rs USING (ticker, date)
WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)""",
    "targets_by_horizon": f"WITH {_PX} " + " UNION ALL ".join(f"SELECT ticker, date, CAST({h} AS INT) AS horizon, '{mode}' AS mode, lead(date, {h}) OVER w AS target_date, round(lead(close, {h}) OVER w{div}, 6) AS target FROM px {_W}" for h in (1, 5, 20) for mode, div in (("next_close", ""), ("next_return", " / nullif(close, 0) - 1"))),
    "volume_features": f"WITH {_PX} SELECT ticker, date, round(ln(1 + greatest(volume, 0)), 6) AS volume_log, round(volume / nullif(lag(volume) OVER w, 0) - 1, 6) AS volume_change FROM px {_W}",
    "intraday_ratios": f"WITH {_PX} SELECT ticker, date, round((close - open) / nullif(open, 0), 6) AS open_close_pct, round((high - low) / nullif(close, 0), 6) AS high_low_pct FROM px",
    "log_returns": f"WITH {_PX} SELECT ticker, date, round(ln(close) - lag(ln(close)) OVER w, 6) AS log_return FROM px {_W}",
    "targets_next_return": f"WITH {_PX} SELECT ticker, date, round(close, 6) AS close, lead(date) OVER w AS target_date, round(lead(close) OVER w / nullif(close, 0) - 1, 6) AS target FROM px {_W}",
    "chronological_split": f"WITH {_SPLIT} SELECT ticker, n, train_end, val_end, split, count(*) AS n_sequences FROM sp GROUP BY ALL",
    "train_scaled_features": f"WITH {_SPLIT}, f AS (SELECT ticker, avg(close) AS cm, stddev_pop(close) AS cs, avg(volume) AS vm, stddev_pop(volume) AS vs FROM sp WHERE pos < train_end GROUP BY ticker) SELECT ticker, date, round((close - cm) / CASE WHEN cs = 0 THEN 1 ELSE cs END, 6) AS close_z, round((volume - vm) / CASE WHEN vs = 0 THEN 1 ELSE vs END, 6) AS volume_z FROM sp JOIN f USING (ticker)",
    "sequence_windows": f"WITH {_SPLIT} SELECT ticker, date, split, n_steps, round(first_close, 2) AS first_close, round(total, 2) AS total FROM (SELECT ticker, date, split, CAST(count(*) OVER x AS INT) AS n_steps, first(close) OVER x AS first_close, sum(close + volume) OVER x AS total FROM sp WINDOW x AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)) WHERE n_steps = 10",
    "persistence_metrics": f"WITH {_PX}, p AS (SELECT ticker, close AS predicted, lead(close) OVER w AS actual FROM px {_W}) SELECT ticker, {_PRICE_ERR}, 0.0::DOUBLE AS directional_coverage FROM p WHERE actual IS NOT NULL GROUP BY ticker",
    "price_error_metrics": f"WITH {_PX}, p AS (SELECT ticker, close, 2 * close - lag(close) OVER w AS predicted, lead(close) OVER w AS actual FROM px {_W}) SELECT ticker, {_PRICE_ERR}, round(avg(CASE WHEN sign(actual - close) * sign(predicted - close) <> 0 THEN (sign(actual - close) = sign(predicted - close))::INT END), 6) AS directional_accuracy, round(avg((sign(actual - close) * sign(predicted - close) <> 0)::INT), 6) AS directional_coverage FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY ticker",
    "regression_metrics": f"WITH {_PX}, {_RETS}, p AS (SELECT ticker, ret AS actual, lag(ret) OVER w AS predicted FROM rt {_W}) SELECT ticker, {_ERR} FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY ticker",
    "normalized_close": f"WITH {_PX} SELECT ticker, date, round(close / first(close) OVER w, 6) AS normalized_close FROM px {_W}",
}
