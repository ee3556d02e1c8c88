"""Scorers and forecasters: a lexicon scorer in columns, a plug for batched models, and sequence forecasters by series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recurrent import VERSION, Forecaster, Settings

POSITIVE = ("gain", "rise", "profit", "growth", "beat", "strong", "record", "up")
NEGATIVE = ("loss", "fall", "decline", "weak", "miss", "drop", "risk", "down")


def lexicon_scores(df: DataFrame, text: str, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> DataFrame:
    """ML1: probabilities of negative, neutral and positive from word counts by softmax, and the label of the largest."""
    hits = lambda words: F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(words) + r")\b")).cast("double")
    df = df.withColumn("_p", hits(positive)).withColumn("_n", hits(negative))
    total = F.exp("_p") + F.exp("_n") + F.exp(F.lit(0.5))
    for name, value in (("negative", F.exp("_n")), ("neutral", F.exp(F.lit(0.5))), ("positive", F.exp("_p"))):
        df = df.withColumn(f"prob_{name}", value / total)
    best = F.greatest("prob_negative", "prob_neutral", "prob_positive")
    return df.withColumn("label", F.when(F.col("prob_neutral") == best, "neutral").when(F.col("prob_negative") == best, "negative").otherwise("positive")).drop("_p", "_n")


def batched_scores(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[str]]], name: str = "generated", batch: int = 32) -> DataFrame:
    """ML1, ML2: a column of what a model gives for each text; ``load`` runs once a task, in the worker."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"{name} string"])

    def run(frames):
        model = load()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            frame[name] = [x for i in range(0, len(texts), batch) for x in model(texts[i : i + batch])]
            yield frame

    return df.mapInPandas(run, schema)


def text_classifier(df: DataFrame, text: str, label: str, features: int = 1 << 14):
    """ML3's native form: a pipeline of hashed TF-IDF and logistic regression, fitted to rows with a label (0, 1, ...)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(df)


_FITTED = "kind string, version int, best_epoch int, history array<struct<epoch:int,train_loss:double,val_loss:double>>, model binary"


def _windows(frame: pd.DataFrame) -> np.ndarray:
    return np.array([[list(step) for step in steps] for steps in frame["steps"]], float)


def trained(sequences: DataFrame, key: str = "ticker", kinds: tuple[str, ...] = ("lstm", "gru"), settings: Settings = Settings()) -> DataFrame:
    """ML5, ML6: a fitted forecaster for each series and kind, with its errors by epoch; a frame that can be saved.

    ``sequences`` has ``steps`` (a list of feature lists), ``target`` and ``split``. A task holds one series, a few thousand
    market days; series without training rows have no model.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        split = frame["split"].to_numpy()
        if not (split == "train").any():
            return pd.DataFrame(columns=[key, "kind", "version", "best_epoch", "history", "model"])
        kind = frame["kind"].iloc[0]
        fitted, history = Forecaster.fitted(kind, _windows(frame), frame["target"].to_numpy(float), split, settings)
        told = [{"epoch": e, "train_loss": t, "val_loss": v} for e, t, v in history]
        return pd.DataFrame({key: [frame[key].iloc[0]], "kind": [kind], "version": [VERSION], "best_epoch": [fitted.network.best_epoch], "history": [told], "model": [fitted.dumps()]})

    rows = sequences.select(key, "date", "steps", "split", F.col("target").cast("double").alias("target")).where("target is not null and split in ('train', 'val')")
    # a fit takes long for its few bytes: a given number of partitions isn't coalesced by size
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).repartition(parts, key, "kind")
    return each.groupBy(key, "kind").applyInPandas(run, f"{key} {dict(sequences.dtypes)[key]}, {_FITTED}")


def forecasts(sequences: DataFrame, fitted: DataFrame, key: str = "ticker") -> DataFrame:
    """Forecasts of the test rows' ``target`` by each of the series' models: key, kind, date, actual, predicted."""

    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(columns=[key, "kind", "date", "actual", "predicted"])]
        if len(frame):
            x = _windows(frame)
            parts = [frame[[key, "date"]].assign(kind=r.kind, actual=frame["target"], predicted=Forecaster.loads(r.model).predict(x)) for r in own.itertuples()] or parts
        return pd.concat(parts)[[key, "kind", "date", "actual", "predicted"]]

    rows = sequences.select(key, "date", "steps", F.col("target").cast("double").alias("target"), "split").where("target is not null and split = 'test'").drop("split")
    return rows.groupBy(key).cogroup(fitted.select(key, "kind", "model").groupBy(key)).applyInPandas(run, f"{key} {dict(sequences.dtypes)[key]}, kind string, date date, actual double, predicted double")


def history(fitted: DataFrame, key: str = "ticker") -> DataFrame:
    """Errors by epoch, a row each."""
    return fitted.select(key, "kind", F.inline("history")).withColumnRenamed("col", "epoch")


def forecast(sequences: DataFrame, key: str = "ticker", kinds: tuple[str, ...] = ("gru",), settings: Settings = Settings()) -> DataFrame:
    """ML5-ML8: train and forecast in one plan."""
    return forecasts(sequences, trained(sequences, key, kinds, settings), key)


def save(fitted: DataFrame, path: str) -> None:
    """K7: fitted models as a table, wherever Spark can write."""
    fitted.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Saved models; an error if any is of another version."""
    fitted = spark.read.parquet(path)
    if others := [r.version for r in fitted.select("version").distinct().collect() if r.version != VERSION]:
        raise ValueError(f"models of version {others}; this reads {VERSION}")
    return fitted
