"""A Merkle manifest of a dataset: every row a leaf, a tree of fanout 16 for each source, and a tree over their roots.

Leaves are hashed by built-in functions. Rows are then dealt by range of (source, doc_id), so that a hot source spreads
over many partitions, and a leaf's index in its source follows from the counts of the ranges before. Each partition
keeps a mountain range: a stack of unfinished runs by level. A run of 16 consecutive nodes (or a source's last, shorter
one) that began on its bound becomes a node one level up, like a carry; runs that a partition's bounds cut leave
their members as edges. Edges, a few for each level and partition, are merged level by level with a shuffle on
(source, run). Roots of sources are the leaves of one more tree, built in the same way.

A leaf's proof is what stands beside it on every level. Leaves are checked in aligned blocks of 4096, to which the way
from the block to the root is joined, so a task holds one block at a time.

Cases: null fields count as ``-``; a null source is a source of its own, the first; a null doc_id is the first of its
source and isn't tampered with; equal doc_ids go by their leaves, and equal rows are leaves of their own; an empty table has no
rows and no root; very long texts are hashed where they are, without leaving the JVM; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.market import lookup
from .kernel import Tables, arrow_schema, bound_batches, fold, table, tidy

FANOUT = 16
#: Proofs are made for blocks of FANOUT ** BLOCK_LEVEL leaves.
BLOCK_LEVEL = 3
BLOCK = FANOUT**BLOCK_LEVEL
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree string, level int, index bigint, hash string, n bigint"


def digest(*fields: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of fields, each as its length in bytes, a colon and its value, or - for null."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame, found: Column | None = None, where: Column | None = None) -> DataFrame:
    """``tree`` (the source, as a text that puts null first), ``doc_id``, ``leaf``, and ``found``: the leaf of the rows ``where`` with another text."""
    fields = {c: F.col(c) for c in FIELDS}
    other = digest(*(fields | {"text": found}).values()) if found is not None else F.lit(None).cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("-")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), digest(*fields.values()).alias("leaf"), (other if where is None else F.when(where, other)).alias("found"))


def indexed(rows: DataFrame, order: list[str], tables: Tables) -> DataFrame:
    """``rows`` with each one's ``index`` in its ``tree``, in the given order, and the tree's size ``n``.

    Rows of a range stay in order (unless the ranges are too many for a broadcast: then runs are cut shorter, and
    more is left to the merging of edges).
    """
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    placed = tables.shared(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("pos", 33))
    ranges = placed.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    shifts = tables.shared(ranges.select("tree", "part", (F.sum("size").over(tree.orderBy("part")) - F.col("size") - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n")))
    return placed.join(lookup(shifts), ["tree", "part"]).withColumn("index", F.col("pos") + F.col("shift")).drop("part", "pos", "shift")


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Mountains:
    """The stack of one tree's unfinished runs. ``nodes`` and ``edges`` gather (level, index, hash)."""

    def __init__(self, n: int):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.runs: list[tuple[int, list[str]]] = [(0, []) for _ in self.sizes]
        self.nodes: list[tuple[int, int, str]] = []
        self.edges: list[tuple[int, int, str]] = []

    def push(self, index: int, value: str, level: int = 0) -> None:
        """Add a leaf; carry full runs up."""
        while True:
            if level or self.sizes[0] == 1:
                self.nodes.append((level, index, value))
            if self.sizes[level] == 1:
                return
            start, run = self.runs[level]
            if not run:
                start = index
            run.append(value)
            self.runs[level] = (start, run)
            if (index + 1) % FANOUT and index + 1 < self.sizes[level]:
                return
            if start % FANOUT:
                self._leave(level)
                return
            self.runs[level] = (0, [])
            index, value, level = index // FANOUT, _hash(run), level + 1

    def _leave(self, level: int) -> None:
        start, run = self.runs[level]
        self.edges += [(level, start + i, h) for i, h in enumerate(run)]
        self.runs[level] = (0, [])

    def close(self) -> None:
        """Runs that no more rows will fill become edges."""
        for level in range(len(self.runs)):
            self._leave(level)


def _grown(rows: DataFrame) -> DataFrame:
    """Nodes and edges of the consecutive leaves in each task's rows."""
    out = arrow_schema(_NODE + ", edge boolean")
    bound_batches(rows.sparkSession)

    def run(batches):
        tree, at, range_ = None, None, None
        done: list[tuple] = []

        def told(m):
            done.extend((tree, *x, m.sizes[0], False) for x in m.nodes)
            done.extend((tree, *x, m.sizes[0], True) for x in m.edges)
            m.nodes, m.edges = [], []

        for batch in batches:
            for name, index, n, leaf in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if range_ is None or name != tree or index != at:
                    if range_ is not None:
                        range_.close()
                        told(range_)
                    tree, range_ = name, Mountains(n)
                range_.push(index, leaf)
                at = index + 1
            if range_ is not None:
                told(range_)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
                done = []
        if range_ is not None:
            range_.close()
            told(range_)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)

    return rows.select("tree", "index", "n", "leaf").mapInArrow(tidy(run), _NODE + ", edge boolean")


def _size(level: int) -> Column:
    """Nodes that a tree of ``n`` leaves has on a level."""
    return F.ceil(F.col("n") / F.lit(FANOUT**level))


def nodes(rows: DataFrame, tables: Tables) -> DataFrame:
    """All nodes above the leaves (a lone leaf counts as its tree's root), as tree, level, index, hash, n and ``top``."""
    grown = tables.shared(_grown(rows))
    most = rows.agg(F.max("n")).first()[0] or 1
    names = ["tree", "level", "index", "hash", "n"]
    parts, merged, level = [grown.where("not edge").select(*names)], None, 0
    while FANOUT**level < most:
        members = grown.where(F.col("edge") & (F.col("level") == level)).select(*names)
        if merged is not None:
            members = members.unionByName(merged.where(_size(level) > 1))
        run = F.array_sort(F.collect_list(F.struct("index", "hash")))
        runs = members.groupBy("tree", "n", F.floor(F.col("index") / FANOUT).alias("parent")).agg(run.alias("run"))
        level += 1
        merged = runs.select("tree", F.lit(level).alias("level"), F.col("parent").alias("index"), F.sha2(F.array_join(F.col("run.hash"), ""), 256).alias("hash"), "n")
        parts.append(merged)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    size = F.ceil(F.col("n") / F.pow(F.lit(float(FANOUT)), F.col("level")))
    return tables.shared(out.withColumn("top", size == 1))


def paths(found: DataFrame, down: int, highest: int) -> DataFrame:
    """For each node of level ``down`` (and roots above it that level): ``path``, what stands left and right of it and of each node above it in its tree."""
    out = None
    empty = F.array().cast("array<struct<left:string,right:string>>")
    for level in range(highest, down - 1, -1):
        here = found.where(F.col("level") == level)
        tops = here.where("top").select("tree", "index", empty.alias("path"))
        if out is None:
            out = tops
            continue
        run = F.array_sort(F.collect_list(F.struct("index", "hash")))
        runs = here.where("not top").groupBy("tree", F.floor(F.col("index") / FANOUT).alias("parent")).agg(run.alias("run"))
        each = runs.join(out.withColumnRenamed("index", "parent"), ["tree", "parent"]).select("tree", "run", "path", F.posexplode("run").alias("p", "own"))
        hashes = F.col("run.hash")
        beside = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("p")), "").alias("left"), F.array_join(F.slice(hashes, F.col("p") + 2, F.lit(FANOUT)), "").alias("right"))
        out = each.select("tree", F.col("own.index").alias("index"), F.concat(F.array(beside), "path").alias("path")).unionByName(tops)
    return out if out is not None else found.select("tree", "index", empty.alias("path")).limit(0)


@dataclass
class Manifest:
    """``rows``: leaves with index and n; ``nodes``: of all sources' trees; ``sources``: their roots as leaves of the last tree,
    whose nodes are ``above``; ``root``: of all, None for an empty table."""

    rows: DataFrame
    nodes: DataFrame
    sources: DataFrame
    above: DataFrame
    root: str | None


def manifest(found: DataFrame) -> Manifest:
    """The manifest of some ``leaves``."""
    tables = Tables()
    rows = indexed(tables.shared(found), ["doc_id", "leaf"], tables)
    under = nodes(rows, tables)
    subroots = under.where("top").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("n").alias("size"), F.col("hash").alias("leaf"))
    sources = indexed(subroots, ["source"], tables)
    above = nodes(sources, tables)
    root = above.where("top").select("hash").first()
    return Manifest(rows, under, sources, above, root[0] if root else None)


def _highest(found: DataFrame) -> int:
    return found.agg(F.max("level")).first()[0] or 0


def checked(m: Manifest) -> DataFrame:
    """For each leaf: its proof, and the root that follows from it, or from the leaf found in its place."""
    over = m.above.where("level > 0").unionByName(m.sources.select("tree", F.lit(0).alias("level"), "index", F.col("leaf").alias("hash"), "n", (F.col("n") == 1).alias("top")))
    ways = m.sources.select("index", F.col("source").alias("tree"), "size", F.col("leaf").alias("subroot")).join(paths(over, 0, _highest(over)).select("index", F.col("path").alias("above")), "index").drop("index")
    # a tree without nodes as high as a block is one block
    low = ways.where(F.col("size") <= FANOUT ** (BLOCK_LEVEL - 1)).select("tree", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    blocks = paths(m.nodes, BLOCK_LEVEL, _highest(m.nodes)).select("tree", F.col("index").alias("block"), "path").unionByName(low)
    blocks = blocks.join(lookup(ways, 2000), "tree").select("tree", "block", F.lit(-1).cast("bigint").alias("index"), F.col("size").alias("n"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("found"), "subroot", F.concat("path", "above").alias("path"))
    rows = m.rows.select("tree", F.floor(F.col("index") / BLOCK).alias("block"), "index", "n", "doc_id", "leaf", "found", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("array<struct<left:string,right:string>>").alias("path"))
    stream = blocks.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out, root = arrow_schema(schema), m.root
    bound_batches(stream.sparkSession)

    def run(batches):
        way, members, ready = None, [], []

        def told():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), out, strict=True)], schema=out)
            ready.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(2, 9)), strict=True):
                if row[0] >= 0:
                    members.append((row[2], row[3], row[4]))
                    continue
                if way:
                    ready += _block(members, *way, root)
                way, members = (row[1], row[5], [(x["left"], x["right"]) for x in row[6]]), []
                if len(ready) >= BLOCK:
                    yield from told()
        if way:
            ready += _block(members, *way, root)
        if ready:
            yield from told()

    return stream.mapInArrow(tidy(run), schema)


def _block(members: list[tuple], n: int, subroot: str, way: list[tuple[str, str]], root: str) -> list[tuple]:
    """Rows of one block of a tree of ``n`` leaves; ``way`` leads from the block's node to the root."""
    levels, size = [[leaf for _, leaf, _ in members]], n
    while len(levels) < BLOCK_LEVEL and -(-size // FANOUT) > 1:
        levels.append([_hash(levels[-1][i : i + FANOUT]) for i in range(0, len(levels[-1]), FANOUT)])
        size = -(-size // FANOUT)
    rows = []
    for first in range(0, len(members), FANOUT):
        run, up = levels[0][first : first + FANOUT], []
        for level in range(1, len(levels)):
            at = first // FANOUT**level
            low = at - at % FANOUT
            up.append(("".join(levels[level][low:at]), "".join(levels[level][at + 1 : low + FANOUT])))
        up += way
        beyond = "".join(left + right for left, right in up)
        lone = n == 1
        whole = _folded(run[0] if lone else _hash(run), up)
        for i, (doc_id, leaf, found) in enumerate(members[first : first + FANOUT]):
            beside = "".join(run[:i]) + "".join(run[i + 1 :]) if not lone else ""
            folded = whole
            if found is not None and found != leaf:
                folded = _folded(found if lone else _hash([*run[:i], found, *run[i + 1 :]]), up)
            rows.append((doc_id, leaf, subroot, root, hashlib.sha256((beside + beyond).encode()).hexdigest(), folded, folded == root))
    return rows


def _folded(value: str, way: list[tuple[str, str]]) -> str:
    for left, right in way:
        value = _hash([left, value, right])
    return value


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.col("doc_id").isNotNull() & (fold("doc_id", 5) == 0)
    return checked(manifest(leaves(docs, F.translate("text", _CAPITALS, _SMALL), tampered)))


def _levels(name: str, first: str, n: int) -> str:
    """SQL: nodes of ``n`` levels over ``first`` (tree, i, n, h), each with what stands beside it."""
    run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
    beside = f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    parts = [f"{name}0 AS (SELECT *, {beside} FROM {first})"]
    parts += [f"{name}{k} AS (SELECT *, {beside} FROM (SELECT tree, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY tree, i // 16))" for k in range(1, n)]
    return ", ".join(parts)


def _oracle(low: int = 6, high: int = 4) -> str:
    """SQL for up to 16 ** (low - 1) rows a source and 16 ** (high - 1) sources."""
    told = lambda cols: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in cols) + ")"
    small = f"translate(text, '{_CAPITALS}', '{_SMALL}')"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    step = lambda x, a: f"CASE WHEN {a}.n = 1 THEN {x} ELSE sha256({a}.l || {x} || {a}.r) END"
    chain = [f"s{k}" for k in range(low)] + [f"u{k}" for k in range(high)]
    joins = "".join(f" JOIN s{k} ON s{k}.tree = lf.tree AND s{k}.i = lf.i // {16**k}" for k in range(low)) + "".join(f" JOIN u{k} ON u{k}.i = lf.o // {16**k}" for k in range(high))
    laterals, x = "", "CASE WHEN lf.bad THEN lf.found ELSE lf.leaf END"
    for k, a in enumerate(chain):
        laterals += f", LATERAL (SELECT {step(x, a)} AS x) AS f{k}"
        x = f"f{k}.x"
    proof = "sha256(" + " || ".join(f"{a}.l || {a}.r" for a in chain) + ")"
    return f"""
WITH RECURSIVE g(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
d AS (SELECT doc_id, coalesce('1' || source, '-') AS tree, {told(FIELDS)} AS leaf, {told([*FIELDS[:-1], small])} AS found, coalesce({crc} % 5 = 0, false) AS bad FROM documents, tab),
od AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS o FROM (SELECT DISTINCT tree FROM d)),
lf AS (SELECT d.*, o, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN od USING (tree)),
lh AS (SELECT tree, i, n, leaf AS h FROM lf), {_levels("s", "lh", low)},
sr AS (SELECT '' AS tree, o AS i, count(*) OVER () AS n, h FROM s{low - 1} JOIN od USING (tree)), {_levels("u", "sr", high)}
SELECT lf.doc_id, lf.leaf, sr.h AS subroot, u{high - 1}.h AS root, {proof} AS proof_sha256, {x} AS folded_root, {x} = u{high - 1}.h AS verified
FROM lf{joins} JOIN sr ON sr.i = lf.o{laterals}
"""


ORACLE = _oracle()
