"""A raw news corpus to a clean one, with the rows of each stage counted in the pass that writes it."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T


@dataclass
class Counters:
    """The rows that pass each stage; known once an action has run over the whole frame."""

    stages: dict[str, Observation] = field(default_factory=dict)

    def at(self, df: DataFrame, name: str) -> DataFrame:
        self.stages[name] = Observation(f"{name}_{id(self)}")
        return df.observe(self.stages[name], F.count(F.lit(1)).alias("n"))

    def report(self) -> dict[str, int]:
        """Rows by stage, and those that deduplication dropped; waits for the action."""
        out = {name: int(o.get["n"]) for name, o in self.stages.items()}
        for a, b, name in (("rows_after_text_filters", "rows_after_url_dedupe", "rows_dropped_duplicate_url"), ("rows_after_url_dedupe", "rows_after_text_dedupe", "rows_dropped_duplicate_text")):
            if a in out and b in out:
                out[name] = out[a] - out[b]
        return out


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """W15 in one pass: of each key the first row in ``order``; a row without a key (null) stays.

    Rows are reduced where they are before they meet, so a key that a third of all rows share is one row a task.
    """
    own = F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"), F.lit("|"), F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    rows = df.select(F.coalesce(F.concat(F.lit("k"), key), own).alias("_k"), F.struct(*df.columns).alias("_r"), F.struct(*order).alias("_o"))
    return rows.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def preprocess(df: DataFrame, min_date: datetime.date, order: str, min_body: int = 80, dedupe_text: bool = True) -> tuple[DataFrame, Counters]:
    """Cleaned source, category, url, title, date and body, filtered and deduplicated.

    ``order`` numbers rows uniquely: of equal urls, then of equal texts, the least stays; rows without a url aren't compared by it.
    Nulls count as empty.
    """
    counters = Counters()
    names = ("source", "category", "url", "title", "date", "body")
    df = counters.at(df.select(order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]), "rows_loaded")
    df = df.withColumn("_day", D.normalised("date"))
    df = counters.at(df.where("_day is not null"), "rows_with_valid_date")
    df = counters.at(df.where(F.col("_day") >= F.lit(min_date)), "rows_after_min_date")
    for c in ("source", "category", "title", "body"):
        df = T.clean(df, c)
    df = T.distinct_sentences(df, "body").withColumns({"url": T.canonical_url("url"), "date": F.date_format("_day", "yyyy-MM-dd"), "source": F.when(F.col("source") == "", "unknown_source").otherwise(F.col("source"))}).drop("_day")
    df = counters.at(df.where((F.length("title") > 0) & (F.length("body") >= min_body)), "rows_after_text_filters")
    df = counters.at(keep_first(df, F.nullif("url", F.lit("")), order), "rows_after_url_dedupe")
    if dedupe_text:
        df = counters.at(keep_first(df, T.fingerprint("title", "body"), order), "rows_after_text_dedupe")
    return df, counters
