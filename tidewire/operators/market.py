"""Daily sentiment, alignment to trading days, price series, indicators, windows and splits.

Everything is keyed by series, so many tickers run side by side; nothing is ordered globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup side of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def daily_sentiment(scored: DataFrame, day: str, *keys: str) -> DataFrame:
    """A1: one row a day (and key). ``scored``: calendar_date, score and ``day``."""
    share = lambda c: F.avg(c.cast("double"))
    return scored.groupBy(*keys, day).agg(
        F.count("*").alias("article_count"),
        F.avg("score").alias("sentiment_score_mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sentiment_score_std"),
        share(F.col("score") > 0).alias("positive_ratio"),
        share(F.col("score") < 0).alias("negative_ratio"),
        share(F.col("score") == 0).alias("neutral_ratio"),
        F.count_distinct("calendar_date").alias("source_day_count"),
        F.min("calendar_date").alias("first_calendar_date"),
        F.max("calendar_date").alias("last_calendar_date"),
    )


def align(scored: DataFrame, calendar: DataFrame, mode: str) -> DataFrame:
    """Adds ``market_date``. ``calendar`` has distinct market_date; mode same_day, same_or_next or next_only.

    Each trading day owns the calendar days since the one before it, so the as-of join becomes an equi-join on a
    map of one row a calendar day. Rows after the last trading day drop.
    """
    if mode == "same_day":
        return scored.join(lookup(calendar.select(F.col("market_date").alias("calendar_date"), "market_date")), "calendar_date")
    first = scored.agg(F.min("calendar_date").alias("first"))
    strict = int(mode == "next_only")
    # the calendar itself is one small ordered series
    owned = calendar.crossJoin(first).withColumn("prev", F.lag("market_date").over(Window.orderBy("market_date")))
    begin = F.coalesce(F.date_add("prev", 1 - strict), F.least("first", F.date_sub("market_date", strict)))
    days = owned.select("market_date", F.explode(F.sequence(begin, F.date_sub("market_date", strict))).alias("calendar_date"))
    return scored.join(lookup(days), "calendar_date")


def bars(lines: DataFrame, day: Column, ticker: Column) -> DataFrame:
    """Daily open, high, low, close and volume from priced lines."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.groupBy(ticker.alias("ticker"), day.alias("date")).agg(F.min_by("l_extendedprice", order).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", order).alias("close"), F.sum("l_quantity").alias("volume"))


def series(*keys: str, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def change(value: str | Column, w, steps: int = 1) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return ratio(value, F.lag(value, steps).over(w)) - 1


def returns(prices: DataFrame, lags: tuple[int, ...] = (0, 1, 2), key: str = "ticker") -> DataFrame:
    """return_tplus{k}_1d, the one-day return k rows ahead."""
    w = series(key)
    df = prices.withColumn("return_tplus0_1d", change("close", w))
    return df.withColumns({f"return_tplus{k}_1d": F.lead("return_tplus0_1d", k).over(w) for k in lags if k})


def full(value: Column, over, n: int, agg) -> Column:
    """A rolling aggregate that is null until ``n`` values are there."""
    return F.when(F.count(value).over(over) == n, agg(value).over(over))


def sma_gap(n: int, key: str = "ticker") -> Column:
    w = series(key).rowsBetween(1 - n, 0)
    return ratio(F.col("close"), full(F.col("close"), w, n, F.avg)) - 1


def volatility(value: Column, n: int, key: str = "ticker") -> Column:
    return full(value, series(key).rowsBetween(1 - n, 0), n, F.stddev_samp)


def smoothed(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds, by name, the exponential mean of a column with a given alpha: y0 = x0, y = alpha * x + (1 - alpha) * y.

    Null until the first value; a null leaves the mean as it was. Values are numbered in blocks of a series. A mean is
    its block's own weighted sum plus what is left of the mean at the block's beginning, and that comes from the sums of as many
    blocks before as still count in double precision. So no row waits for the one before, and windows spill.
    """
    for column in dict.fromkeys(c for c, _ in specs.values()):
        own = {n: a for n, (c, a) in specs.items() if c == column}
        df = _smoothed(df, column, own, key, order)
    return df


def _horner(values: Column, factor: float) -> Column:
    """The last value, plus ``factor`` times the one before it, and so on."""
    return F.reduce(values, F.lit(0.0), lambda acc, x: acc * F.lit(factor) + x)


def _smoothed(df: DataFrame, column: str, alphas: dict[str, float], key: str, order: str) -> DataFrame:
    steady = {n: 1 - a for n, a in alphas.items() if a < 1}
    value, w = F.col(column).cast("double"), series(key, order=order)
    df = df.withColumns({n: F.last(value, ignorenulls=True).over(w) for n in alphas if n not in steady})
    if not steady:
        return df
    # within a block the least weight is at least 1e-4 of the largest
    size = max(1, int(math.log(1e4) / -math.log(min(steady.values()))))
    nth = F.count(value).over(w)
    df = df.withColumn("_n", nth).withColumn("_block", F.floor((F.col("_n") - 1) / size)).withColumn("_i", (F.col("_n") - 1) % size)
    # the first value has the whole weight
    weighted = {n: value * F.when(F.col("_n") == 1, 1.0).otherwise(1 - q) * F.pow(F.lit(q), -F.col("_i")) for n, q in steady.items()}
    inside = Window.partitionBy(key, "_block").orderBy(order)
    rows = df.withColumns({f"_s_{n}": F.sum(x).over(inside) for n, x in weighted.items()})
    # a block's last value stands for it; nulls aren't collected
    last = value.isNotNull() & (F.col("_i") == size - 1)
    before = {}
    for n, q in steady.items():
        count = max(1, math.ceil(math.log(1e-18) / (size * math.log(q))))
        ends = F.collect_list(F.when(last, F.col(f"_s_{n}") * q ** (size - 1))).over(Window.partitionBy(key).orderBy("_block").rangeBetween(-count, -1))
        before[f"_b_{n}"] = _horner(ends, q**size)
    rows = rows.withColumns(before)
    out = {n: F.when(F.col("_n") > 0, F.col(f"_s_{n}") * F.pow(F.lit(q), F.col("_i")) + F.col(f"_b_{n}") * F.pow(F.lit(q), F.col("_i") + 1)) for n, q in steady.items()}
    return rows.withColumns(out).drop("_n", "_block", "_i", *[f"_{x}_{n}" for n in steady for x in "sb"])


def span(n: int) -> float:
    return 2 / (n + 1)


def rsi(df: DataFrame, n: int = 14, key: str = "ticker") -> DataFrame:
    """Wilder's index; 50 while warming up and where there was no loss."""
    w = series(key)
    moved = df.withColumn("_delta", F.col("close") - F.lag("close").over(w))
    moved = moved.withColumns({"_gain": F.greatest("_delta", F.lit(0.0)), "_loss": F.greatest(-F.col("_delta"), F.lit(0.0))})
    # greatest skips nulls: no move, no gain
    moved = moved.withColumns({c: F.when(F.col("_delta").isNotNull(), F.col(c)) for c in ("_gain", "_loss")})
    means = smoothed(moved, {"_up": ("_gain", 1 / n), "_down": ("_loss", 1 / n)}, key).withColumn("_seen", F.count("_delta").over(w))
    value = F.when((F.col("_seen") < n) | F.col("_delta").isNull() | (F.col("_down") == 0), 50.0).otherwise(100 - 100 / (1 + ratio(F.col("_up"), F.col("_down"))))
    return means.withColumn("rsi", value).drop("_delta", "_gain", "_loss", "_up", "_down", "_seen")


PRICE_FEATURES = ("close", "return_1d", "log_return_1d", "volume_log1p", "volume_change_1d", "sma_5_gap", "sma_10_gap", "ema_5_gap", "ema_10_gap", "volatility_5", "volatility_10", "rsi_14", "macd", "macd_signal", "macd_hist")
SENTIMENT_FEATURES = ("sentiment_score_mean", "sentiment_score_std", "article_count_log1p", "positive_ratio", "negative_ratio", "neutral_ratio", "source_day_count")


def macd(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Adds macd, macd_signal and macd_hist of ``close``."""
    df = smoothed(df, {"_fast": ("close", span(12)), "_slow": ("close", span(26))}, key).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return smoothed(df, {"macd_signal": ("macd", span(9))}, key).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def engineered(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Daily bars with all price features, and article_count_log1p where article_count is there."""
    w = series(key)
    df = prices.withColumns({
        "return_1d": change("close", w),
        "log_return_1d": F.ln("close") - F.lag(F.ln("close")).over(w),
        "open_close_pct": ratio(F.col("close") - F.col("open"), F.col("open")),
        "high_low_pct": ratio(F.col("high") - F.col("low"), F.col("close")),
        "volume_log1p": F.log1p(F.greatest(F.col("volume").cast("double"), F.lit(0.0))),
        "volume_change_1d": change("volume", w),
        "sma_5_gap": sma_gap(5, key),
        "sma_10_gap": sma_gap(10, key),
    })
    df = df.withColumns({f"volatility_{n}": volatility(F.col("return_1d"), n, key) for n in (5, 10)})
    df = smoothed(df, {f"_e{n}": ("close", span(n)) for n in (5, 10)}, key)
    df = df.withColumns({f"ema_{n}_gap": ratio(F.col("close"), F.col(f"_e{n}")) - 1 for n in (5, 10)}).drop("_e5", "_e10")
    df = macd(rsi(df, key=key).withColumnRenamed("rsi", "rsi_14"), key)
    return df.withColumn("article_count_log1p", F.log1p("article_count")) if "article_count" in prices.columns else df


def targets(df: DataFrame, horizon: int = 1, mode: str = "next_return", key: str = "ticker") -> DataFrame:
    """Adds ``target``, the close or the return ``horizon`` rows ahead, and its date."""
    if mode not in ("next_close", "next_return"):
        raise ValueError(f"no target mode {mode}")
    w = series(key)
    ahead = F.lead("close", horizon).over(w)
    return df.withColumns({"target_date": F.lead("date", horizon).over(w), "target": ahead if mode == "next_close" else ratio(ahead, F.col("close")) - 1})


def split_points(n: Column, length: int) -> tuple[Column, Column]:
    """Ends of the training and validation rows."""
    train = F.greatest(F.floor(n * 0.70), F.lit(length + 5))
    val = F.least(F.greatest(F.floor(n * 0.85), train + 5), n - 5)
    return train.cast("bigint"), val.cast("bigint")


def chronological(df: DataFrame, length: int = 10, key: str = "ticker") -> DataFrame:
    """Adds row number, split ends and the split of the sequence that ends at a row (null before the first full one)."""
    df = df.withColumn("pos", F.row_number().over(series(key)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    train, val = split_points(F.col("n"), length)
    df = df.where(F.col("n") >= max(length + 20, 80)).withColumn("train_end", train).withColumn("val_end", val)
    return df.withColumn("split", F.when(F.col("pos") < length - 1, None).when(F.col("pos") < F.col("train_end"), "train").when(F.col("pos") < F.col("val_end"), "val").otherwise("test"))


def sequences(df: DataFrame, features: list[str], length: int = 10, key: str = "ticker") -> DataFrame:
    """Adds ``steps``, the feature vectors of the last ``length`` rows; shorter ones drop."""
    w = series(key).rowsBetween(1 - length, 0)
    return df.withColumn("steps", F.collect_list(F.array(*features)).over(w)).where(F.size("steps") == length)


def scaled(df: DataFrame, features: list[str], key: str = "ticker") -> DataFrame:
    """Each feature less the training rows' mean, by their population deviation (1 where that is 0)."""
    fit = df.where(F.col("pos") < F.col("train_end")).groupBy(key).agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features])
    return df.join(lookup(fit), key).withColumns({f"{f}_z": (F.col(f) - F.col(f"{f}_m")) / F.when(F.col(f"{f}_s") == 0, 1.0).otherwise(F.col(f"{f}_s")) for f in features}).drop(*[f"{f}_{x}" for f in features for x in "ms"])
