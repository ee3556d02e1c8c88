"""Structured Streaming forms: daily sentiment with late rows, and deduplication by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame, ts: str = "ts", score: str = "score", late: str = "2 days") -> DataFrame:
    """Daily counts and mean scores; rows later than ``late`` drop, and a day's state goes with the watermark."""
    days = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    return days.agg(F.count("*").alias("article_count"), F.avg(score).alias("sentiment_score_mean")).select(F.to_date("window.start").alias("day"), "article_count", "sentiment_score_mean")


def distinct(events: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there, exactly once, into Parquet files."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
