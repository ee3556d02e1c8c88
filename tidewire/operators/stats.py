"""Correlation, regression, direction and Granger statistics by group, and their p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, num: float, den: float) -> float:
    return beta_inc(den / 2, num / 2, den / (den + num * f)) if f > 0 else 1.0


def correlation(x: str, y: str):
    """Pearson's r as a null-safe aggregate: null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_p(df: DataFrame, r: str = "pearson_r", n: str = "n_rows", name: str = "p_value") -> DataFrame:
    """Adds the p-value of a correlation; a result frame, a row a group."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else 0.0 if abs(a) >= 1 else t_p_value(a * math.sqrt((b - 2) / (1 - a * a)), b - 2) for a, b in zip(r, n, strict=True)], dtype="float64")

    return df.withColumn(name, p(F.col(r).cast("double"), F.col(n).cast("double")))


def lag_metrics(pairs: DataFrame, *keys: str, minimum: int = 5) -> DataFrame:
    """A3, A5, A6, A7 over rows (signal, ret) by keys; all but the counts are null under ``minimum`` rows."""
    pairs = pairs.where("signal is not null and ret is not null")
    both = F.sign("signal") * F.sign("ret") != 0
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n_rows"), correlation("signal", "ret").alias("pearson_r"), F.regr_intercept("ret", "signal").alias("intercept"), F.regr_slope("ret", "signal").alias("slope"), F.regr_r2("ret", "signal").alias("r2"), F.avg(F.when(both, (F.sign("signal") == F.sign("ret")).cast("double"))).alias("directional_accuracy"), F.avg(both.cast("double")).alias("directional_coverage"))
    return out.select(*keys, "n_rows", *[F.when(F.col("n_rows") >= minimum, F.col(c)).alias(c) for c in out.columns if c not in (*keys, "n_rows")])


def average_rank(column: str, *keys: str):
    """A4: rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(pairs: DataFrame, *keys: str) -> DataFrame:
    pairs = pairs.where("signal is not null and ret is not null").withColumn("rs", average_rank("signal", *keys)).withColumn("rr", average_rank("ret", *keys))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_rows"), correlation("rs", "rr").alias("spearman_r"))


def full_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """A3-A8 as one frame: Pearson's and Spearman's coefficients and the slope, each with its two-sided p-value.

    With one regressor the slope's t is that of Pearson's r, so is its p. All are null under five rows.
    """
    ranks = spearman(pairs, *keys).drop("n_rows")
    out = lag_metrics(pairs, *keys).join(ranks, list(keys)).withColumn("spearman_r", F.when(F.col("n_rows") >= 5, F.col("spearman_r")))
    out = with_p(out, name="pearson_p")
    return with_p(out, r="spearman_r", name="spearman_p").withColumn("slope_p", F.col("pearson_p"))


def granger_tests(x: np.ndarray, y: np.ndarray, maxlag: int) -> list[tuple[int, float, float, int, int]]:
    """Whether x helps to foretell y: (lag, F, p, denominator and numerator degrees) for each lag."""
    out = []
    n = len(y)
    if n < max(30, 8 * maxlag):
        return out
    for lag in range(1, maxlag + 1):
        own = np.column_stack([y[lag - k : n - k] for k in range(1, lag + 1)])
        other = np.column_stack([x[lag - k : n - k] for k in range(1, lag + 1)])
        target, ones = y[lag:], np.ones((n - lag, 1))

        def left(design, target=target):
            return float(((target - design @ np.linalg.lstsq(design, target, rcond=None)[0]) ** 2).sum())

        few, all_ = left(np.hstack([own, ones])), left(np.hstack([own, other, ones]))
        df = n - lag - 2 * lag - 1
        if df <= 0 or all_ <= 0:
            continue
        f = (few - all_) / lag / (all_ / df)
        out.append((lag, f, f_p_value(f, lag, df), df, lag))
    return out


def granger(daily: DataFrame, maxlag: int = 3, key: str = "ticker", order: str = "date") -> DataFrame:
    """Both directions by series; ``daily`` holds signal and ret. A series is one group of a row a day."""
    def run(frame):
        frame = frame.dropna(subset=["signal", "ret"]).sort_values(order)
        s, r = frame["signal"].to_numpy(float), frame["ret"].to_numpy(float)
        rows = [(d, *t) for d, a, b in (("sentiment_to_return", s, r), ("return_to_sentiment", r, s)) for t in granger_tests(a, b, maxlag)]
        out = pd.DataFrame(rows, columns=["direction", "lag", "f_stat", "p_value", "df_denom", "df_num"])
        out.insert(0, key, frame[key].iloc[0] if len(frame) else None)
        return out

    return daily.select(key, order, "signal", "ret").groupBy(key).applyInPandas(run, f"{key} {dict(daily.dtypes)[key]}, direction string, lag bigint, f_stat double, p_value double, df_denom bigint, df_num bigint")


def granger_best(tests: DataFrame, key: str = "ticker") -> DataFrame:
    """A10: by direction, the lag of least p (then least lag)."""
    return tests.groupBy(key, "direction").agg(F.min_by("lag", F.struct("p_value", "lag")).alias("best_lag"), F.min("p_value").alias("best_p_value")).withColumn("significant", F.col("best_p_value") < 0.05)


def regression_metrics(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted", current: str | None = None) -> DataFrame:
    """Error figures, and direction over rows where both signs count.

    With ``current``, the two are prices: directions are moves from that price, and ``mape`` (per cent, over actual
    prices other than 0) is given; returns, close to 0, have no such figure.
    """
    a, p = F.col(actual), F.col(predicted)
    up, thought = (F.sign(a - F.col(current)), F.sign(p - F.col(current))) if current else (F.sign(a), F.sign(p))
    both = up * thought != 0
    priced = [(100 * F.avg(F.when(F.abs(a) > 1e-8, F.abs((a - p) / a)))).alias("mape")] if current else []
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"), *priced, (1 - F.try_divide(F.sum((a - p) ** 2), F.var_pop(a) * F.count(a))).alias("r2"), F.avg(F.when(both, (up == thought).cast("double"))).alias("directional_accuracy"), F.avg(both.cast("double")).alias("directional_coverage"))
