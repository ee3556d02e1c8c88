"""Connected components of a link table by alternating stars, wholly distributed.

Each round is linear in the links: every node's neighbours are tied to the least of them, first those above
the node, then those below it, until the links form stars around the least node of each component. Rounds
grow with the logarithm of a component's diameter. A hub costs no more than its links: they are dealt out
by hub and salt, minima are taken by salt first, and a hub's minimum goes back once to each of its salts.

Cases: no links give no rows; repeated links and links of a node to itself add nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Tables, tidy

#: Parts of a hub's links.
SALTS = 256
#: Links that a task merges at a time.
MERGED = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links of each node to the least one that the links (a, b) tie it to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    away = parent != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[away], pa.int64()), pa.array(nodes[parent[away]], pa.int64())], ["u", "v"])


def _forest(batches):
    """Of a task's links, those that tie together what was apart, by ``MERGED`` links at a time."""
    parts, size = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= MERGED:
            yield _stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, size = [], 0
    if size:
        yield _stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _with_least(edges: DataFrame) -> DataFrame:
    """Links (u, v) with m, the least of u and all its neighbours."""
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("least"))
    told = parts.select("u", "s", F.least("u", F.min("least").over(Window.partitionBy("u"))).alias("m"))
    return salted.join(told, ["u", "s"]).drop("s")


def components(links: DataFrame, into: Tables | None = None) -> DataFrame:
    """``node`` and ``root``, the least node of its component, of every node of ``links`` (columns a and b, long): a table of ``into``."""
    tables = Tables()
    edges = tables.shared(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(tidy(_forest), "u bigint, v bigint"))
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        tied = _with_least(large.where("u > v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = tables.shared(tied.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        tables.drop_others(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = (into or Tables()).shared(stars.union(stars.select(F.col("root").alias("node"), "root").distinct()))
    tables.drop_others()
    return out
