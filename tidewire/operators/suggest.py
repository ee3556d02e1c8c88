"""Names like those that a user typed, from all names there are."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A name counts as alike from this share of letters in matching blocks.
RATIO = 0.45


def suggestions(names: DataFrame, name: str, wanted: list[str], limit: int = 5) -> DataFrame:
    """For each wanted name the ``limit`` names of highest ratio, at least ``RATIO``, or else those with most of its words.

    Names are compared in lower case. A ratio is twice the letters in matching blocks (the longest common part, then
    those on both sides of it) over the letters of both; equal ratios go by name, the last first, and equal numbers of words the
    first first. ``wanted`` is what someone asks, a short list: it goes to where the names are, and each task keeps its best.
    Returns wanted, name, rank from 1, how (ratio or words) and score; a name that nothing is like has no row.
    """
    asked = [(w, w.lower(), [t for t in re.split(r"[_\W]+", w.lower().rpartition(".")[0] or w.lower()) if t]) for w in dict.fromkeys(wanted)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, str], list[tuple[float, str]]] = {}
        for frame in frames:
            for w, low, words in asked:
                matcher = difflib.SequenceMatcher()
                matcher.set_seq2(low)
                ratios, counts = [], []
                for x in frame["_n"]:
                    matcher.set_seq1(x)
                    # upper bounds first: most names fail them
                    if matcher.real_quick_ratio() >= RATIO and matcher.quick_ratio() >= RATIO and (r := matcher.ratio()) >= RATIO:
                        ratios.append((r, x))
                    if n := sum(t in x for t in words):
                        counts.append((float(n), x))
                best[w, "ratio"] = sorted(best.get((w, "ratio"), []) + ratios, reverse=True)[:limit]
                best[w, "words"] = sorted(best.get((w, "words"), []) + counts, key=lambda p: (-p[0], p[1]))[:limit]
        yield pd.DataFrame([(w, how, s, x) for (w, how), pairs in best.items() for s, x in pairs], columns=["wanted", "how", "score", "name"])

    distinct = names.where(F.col(name).isNotNull()).select(F.lower(name).alias("_n")).distinct()
    found = distinct.mapInPandas(run, "wanted string, how string, score double, name string")
    some = Window.partitionBy("wanted")
    found = found.withColumn("_any", F.max(F.col("how") == "ratio").over(some)).where(~F.col("_any") | (F.col("how") == "ratio")).drop("_any")
    order = [F.desc("score"), F.when(F.col("how") == "ratio", F.col("name")).desc(), F.col("name")]
    return found.withColumn("rank", F.row_number().over(some.orderBy(*order))).where(F.col("rank") <= limit).select("wanted", "name", "rank", "how", "score")
