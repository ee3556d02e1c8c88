"""Classification metrics and report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """A row a gold label and a column a predicted one, in fixed order, zeros where nothing is."""
    counted = df.where(F.col(gold).isin(labels)).groupBy(F.col(gold).alias("gold")).agg(*[F.sum((F.col(pred) == x).cast("bigint")).alias(x) for x in labels])
    all_ = df.sparkSession.createDataFrame([(x,) for x in labels], "gold string")
    return all_.join(counted, "gold", "left").na.fill(0, labels)


def normalised(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """Each row as shares of its sum."""
    total = sum((F.col(x) for x in labels), F.lit(0))
    return matrix.select("gold", *[F.coalesce(F.try_divide(F.col(x), total), F.lit(0.0)).alias(x) for x in labels])


def by_class(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support by label; a share of nothing is 0."""
    sides = df.where(F.col(gold).isin(labels)).select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x"))
    sums = sides.groupBy("x.label").agg(*[F.sum(f"x.{c}").alias(c) for c in ("g", "p", "hit")])
    all_ = df.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(sums, "label", "left").na.fill(0, ["g", "p", "hit"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = all_.withColumn("precision", zero(F.try_divide("hit", "p"))).withColumn("recall", zero(F.try_divide("hit", "g")))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("label", "precision", "recall", "f1", F.col("g").alias("support"), F.col("hit"))


def summary(classes: DataFrame, present_only: bool = False) -> DataFrame:
    """Accuracy, macro and weighted averages; with ``present_only``, of labels that occur."""
    if present_only:
        classes = classes.where((F.col("support") > 0) | (F.col("precision") > 0))
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")]
    return classes.agg(F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"), *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")], *weighted)


def lift(df: DataFrame, keys: list[str], variant: str, metric: str, base: str, other: str) -> DataFrame:
    """How much ``other`` exceeds ``base`` in a metric."""
    return df.groupBy(*keys).agg((F.max(F.when(F.col(variant) == other, F.col(metric))) - F.max(F.when(F.col(variant) == base, F.col(metric)))).alias("lift"))
