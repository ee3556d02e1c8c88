"""Sinks: CSV, reports, output by entity, and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """K1, K2: UTF-8 with a header, in a fixed order of columns."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_with_mark(df: DataFrame, path: str) -> None:
    """K1: the same with a byte-order mark before each file's header, for spreadsheets."""
    line = F.to_csv(F.struct(*df.columns))
    head = df.sparkSession.range(1).select(F.lit("﻿" + ",".join(df.columns)).alias("value"), F.lit(0).alias("o"))
    rows = df.select(line.alias("value"), F.lit(1).alias("o"))
    # one file, as asked for: a report, not a corpus
    head.union(rows).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """K3, K5: a result frame as JSON lines."""
    df.write.mode("overwrite").json(path)


def by_entity(df: DataFrame, path: str, key: str, brief: list[str]) -> None:
    """K4: a full and a brief set of files for each entity."""
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(f"{path}/rich")
    df.select(key, *brief).write.mode("overwrite").partitionBy(key).option("header", True).csv(f"{path}/for_sentiment")


def bundle(df: DataFrame, path: str, title: str, slug: str) -> None:
    """K8: data, metadata and a note."""
    spark = df.sparkSession
    csv(df, f"{path}/data")
    meta = spark.createDataFrame([(title, slug, ["CC0-1.0"])], "title string, id string, licenses array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/dataset-metadata")
    spark.createDataFrame([(f"# {title}\n\nColumns: {', '.join(df.columns)}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/README")


def counted(df: DataFrame, counters, path: str) -> dict[str, int]:
    """The rows and, beside them, a report of the stages' counts, which come from the same pass."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows")
    told = counters.report()
    df.sparkSession.createDataFrame([told], ", ".join(f"{k} bigint" for k in told)).coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return told


def ordered(df: DataFrame, path: str, *order: str, partitions: int | None = None) -> None:
    """O1: files that, one after the other, are in order; rows alike in ``order`` go by their other columns.

    Rows are dealt by ranges and sorted within them: no task sorts all. Nulls come first.
    """
    keys = [*order, *[c for c in df.columns if c not in order]]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
