"""N-gram Jaccard join: a grouped prefix join, exact, that returns classes and components instead of pairs.

A document's set holds its distinct ``SHINGLE``-word shingles as 64-bit hashes. Two sets link when
100 * intersection >= ``PERCENT`` * union. The steps:

1. One pass gives each document its set's size and hash, the prefix (the first n - ceil(0.85 n) + 1 shingles
   in a global order; linked sets share one) and a sketch. In that order the shingles that a bounded sample
   finds frequent come last, so that a passage that many documents share seldom enters a prefix. The sample
   changes speed only: any order gives the same links.
2. Documents with identical prefixes and size form a group, and each group is posted once under each prefix shingle,
   with its size and its reach: what is left of the set from that shingle on bounds the overlap, and so the size of a
   partner whose first common shingle this is. Two groups are a pair under a shingle only if each one's size is within
   the other's reach; groups with no partner in a list leave it. So forms that share a long text but differ by more
   than the similarity allows meet nowhere, whatever their number.
3. Posting lists are expanded to the members, which are the distinct sets of a group. Lists of up to ``SMALL``
   members are searched whole. Longer ones tie each member to ``STARS`` leaders; when those links are verified and
   merged, members outside a list's largest component are held against the others that they can reach, in blocks of
   ``BLOCK`` (lists with the same largest component together).
   Pairs inside a component are never needed, so a group of near copies costs its size, not the square of it.
4. Of the pairs that sizes and reaches admit, the sketches (parities of shingle counts in buckets) bound the
   symmetric difference from below and reject most. What is left is verified on the whole sets.
5. Components of the verified links, by distributed stars.

Cases: a null text, an empty one or one without words has an empty set, links with nothing and is its own component;
fewer than four words make one shingle; exact copies are one class and get its component; a repeated
doc_id is one row each time; a row without a doc_id gets its class's component, or none; other columns are not read. Equal 64-bit hashes count as equal shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import LOWER, Batch, Tables, lists, map_batches, mix, packed, shared, table, tidy, unpacked, utf8, whole_hash

SHINGLE, PERCENT = 4, 85
SMALL, STARS = 64, 8
#: Members of a long list that one block holds.
BLOCK = 4096
#: Rows of the sample that finds frequent shingles, and how often one must occur there.
SAMPLE_ROWS, FREQUENT = 20_000, 4
SKETCH_BUCKETS = 26
#: Identifiers of this many candidate documents at most are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_TOP = np.uint64(63)


def _sets(raw: np.ndarray, off: np.ndarray, frequent: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents (frequent ones above the others), and their offsets."""
    b = Batch(raw, off, LOWER)
    at, h = b.windows(size)
    bounds = np.searchsorted(at, b.word_off)
    short = np.flatnonzero((b.counts > 0) & (b.counts < size))
    if len(short):
        h = np.insert(h, bounds[short], [np.uint64(whole_hash(b.hashes[b.word_off[i] : b.word_off[i + 1]])) for i in short])
        bounds = bounds + np.searchsorted(short, np.arange(b.n + 1))
    keys = h >> np.uint64(1)
    if frequent is not None:
        bucket = h >> np.uint64(64 - SKETCH_BUCKETS)
        keys |= (frequent[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(np.uint64) << _TOP
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        keys[i:j].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[bounds[:-1][bounds[:-1] < len(keys)]] = True
    total = np.append(0, np.cumsum(new))
    return keys[new], total[bounds]


def _whole(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set, by its size and members but not their order."""
    sums = np.append(np.uint64(0), np.cumsum(mix((keys & ~(np.uint64(1) << _TOP)) + np.uint64(0x51ED270B)), dtype=np.uint64))
    return mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64))


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """A bitmap of fixed size of the shingle hashes' buckets that are frequent in the sample."""
    n = docs.count()
    rate = int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1)))
    low = SKETCH_BUCKETS - 6

    def make():
        def work(rows):
            keys, _ = _sets(*utf8(rows.column(0)), None, size)
            bucket = np.sort((keys >> np.uint64(63 - SKETCH_BUCKETS)).astype(np.int64))
            cut = np.searchsorted(bucket, np.arange(65) << low)
            return {"part": np.arange(64), "buckets": lists((bucket & (1 << low) - 1).astype(np.int32), np.diff(cut), pa.int32())}

        return work

    def count(part, found):
        total = np.zeros(1 << low, np.int32)
        for x in found.column("buckets"):
            total += np.bincount(x.values.to_numpy(), minlength=1 << low).astype(np.int32)
        hot = np.flatnonzero(total >= FREQUENT)
        return pa.table({"bucket": pa.array(hot + (part[0].as_py() << low), pa.int64()), "n": pa.array(total[hot], pa.int64())})

    sampled = map_batches(docs.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) <= rate), ["text"], "part int, buckets array<int>", make)
    hot = sampled.groupBy("part").applyInArrow(count, "bucket bigint, n bigint").orderBy(F.desc("n"), "bucket").limit(1 << 20).select("bucket").toArrow()
    bits = np.zeros(1 << SKETCH_BUCKETS, np.uint8)
    bits[hot.column(0).to_numpy()] = 1
    return np.packbits(bits, bitorder="little")


def _parities(doc: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """By document, ``bits[doc]`` buckets, each the parity of how many of the hashes fall into it."""
    start = np.append(0, np.cumsum(bits))
    odd = np.bincount(start[doc] + (hashes & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=start[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist(), strict=True)]


def _profile(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """By row: doc_id, n, the set's hash, the group (hash of prefix and size), prefix and sketch."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def make():
        def work(rows):
            keys, off = _sets(*utf8(rows.column(1)), frequent.value, size)
            n = np.diff(off)
            doc = np.repeat(np.arange(len(n)), n)
            rank = np.arange(len(keys)) - off[:-1][doc]
            mixed = mix(keys + np.uint64(0x51ED270B))
            first = rank < (n + percent * n // -100 + 1)[doc]
            sums = np.append(np.uint64(0), np.cumsum(np.where(first, mix(mixed), np.uint64(0)), dtype=np.uint64))
            whole, group = _whole(keys, off), mix(sums[off[1:]] - sums[off[:-1]] + n.astype(np.uint64))
            bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            sketch, fine = (_parities(doc, mixed, x) for x in (bits, 4 * bits))
            return {"doc_id": rows.column(0), "mark": rows.column(2), "n": n, "node": whole.view(np.int64), "grp": group.view(np.int64), "prefix": lists(keys[first].view(np.int64), np.bincount(doc[first], minlength=len(n)), pa.int64()), "sketch": sketch, "fine": fine}

        return work

    return map_batches(docs, ["doc_id", "text", "mark"], "doc_id bigint, mark bigint, n bigint, node bigint, grp bigint, prefix array<bigint>, sketch binary, fine binary", make)


def _keyed(token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by token and n, sorted keys in which a token's sizes are a range, and the base of each row's token."""
    base = np.cumsum(np.append(0, token[1:] != token[:-1]), dtype=np.int64)[: len(token)] << 32
    return base + n, base


def _shared_postings(batches):
    """Of a task's posting rows (token, group, n, reach), the distinct ones that have a partner in their list; frequent tokens stay in any case."""
    parts = [[b.column(c).to_numpy() for c in range(4)] for b in batches]
    if not parts:
        return
    token, group, n, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((group, n, token))
    token, group, n, reach = (x[order] for x in (token, group, n, reach))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group, n, reach = (x[new] for x in (token, group, n, reach))
    key, base = _keyed(token, n)
    # the smaller of two reaches the larger one's size: it and all sizes from its own up to its reach may pair
    low, high = np.searchsorted(key, key, "left"), np.searchsorted(key, base + reach, "right")
    some = high - low > 1
    cover = np.zeros(len(token) + 1, np.int64)
    np.add.at(cover, low[some], 1)
    np.add.at(cover, high[some], -1)
    stay = (np.cumsum(cover)[:-1] > 0) | (token < 0)
    yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (token, group, n, reach)], ["token", "grp", "n", "reach"])


class _Close:
    """Pairs of a posting list whose sizes fit and whose sketches don't rule a link out.

    Sketches of fitting sizes have the same length or one twice the other's; the longer is folded.
    |x ^ y| = |x| + |y| - 2 |x & y|, and linked sets share percent / (100 + percent) of the sum of sizes at least.
    """

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.length = np.array([len(x) for x in sketches])
        self.rows = np.zeros(len(n), np.int64)
        self.own, self.folded = {}, {}
        for k in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == k)
            self.rows[at] = np.arange(len(at))
            own = self.own[k] = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint8).reshape(len(at), k)
            self.folded[k] = own[:, : k // 2] ^ own[:, k // 2 :]

    def among(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.n[i], self.n[j]
        fit = 100 * np.minimum(p, q) >= self.percent * np.maximum(p, q)
        i, j = i[fit], j[fit]
        swap = self.length[i] > self.length[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        near = np.zeros(len(i), bool)
        for k in np.unique(self.length[i]).tolist():
            for other, source in ((k, self.own), (2 * k, self.folded)):
                at = np.flatnonzero((self.length[i] == k) & (self.length[j] == other))
                for lo in range(0, len(at), step := max(1, (2 << 20) // k)):
                    x = at[lo : lo + step]
                    least = np.bitwise_count(self.own[k][self.rows[i[x]]] ^ source[other][self.rows[j[x]]]).sum(1, dtype=np.int64)
                    near[x] = (100 + self.percent) * least <= (100 - self.percent) * (self.n[i[x]] + self.n[j[x]])
        return i[near], j[near]


def _ranges(rows: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int = 1 << 17):
    """All (row, j) with j from low up to high of the row, some ``limit`` at a time."""
    count = np.maximum(high - low, 0)
    total = np.append(0, np.cumsum(count))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        c = count[at:to]
        yield np.repeat(rows[at:to], c), np.arange(total[to] - total[at]) + np.repeat(low[at:to] - (total[at:to] - total[at]), c)
        at = to


def _close_pairs(percent: int):
    """Over a task's rows (token, salt, node, n, reach, sketch, root, wide): close pairs within each (token, salt).

    With no wide rows all pairs of a list are held against each other; else the wide ones, which are in every block of
    their list, against all of other roots.
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        token, salt, node, n, reach, root, wide = (rows.column(c).to_numpy() for c in ("token", "salt", "node", "n", "reach", "root", "wide"))
        order = np.lexsort((node, n, salt, token))
        token, salt, node, n, reach, root, wide = (x[order] for x in (token, salt, node, n, reach, root, wide))
        _, first, own = np.unique(node, return_index=True, return_inverse=True)
        sketches = rows.column("sketch").take(pa.array(order[first])).to_pylist()
        close = _Close(n[first], sketches, percent)
        lists_ = np.cumsum(np.append(0, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        key, base = _keyed(lists_, n)
        high = np.searchsorted(key, base + reach, "right")
        if wide.any():
            asks = np.flatnonzero(wide)
            blocks = _ranges(asks, np.searchsorted(key, base[asks] + -(percent * n[asks] // -100), "left"), high[asks])
        else:
            asks = np.arange(len(node))
            blocks = _ranges(asks, asks + 1, high)
        found = [np.zeros((0, 2), np.int64)]
        for i, j in blocks:
            keep = (n[i] <= reach[j]) & (root[i] != root[j])
            # two wide rows meet in every block of their list, and count in the first
            keep &= ~wide[j] | ((salt[i] == 0) & (i < j))
            i, j = close.among(own[i[keep]], own[j[keep]])
            if len(i):
                found.append(np.unique(np.sort(np.stack([node[first[i]], node[first[j]]], 1), 1), axis=0))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _starred(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The close ones among pairs (a, b)."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def sketched(batches):
        for batch in batches:
            na, nb, sa, sb = (batch.column(batch.schema.names.index(c)) for c in ("na", "nb", "sa", "sb"))
            n = np.concatenate([na.to_numpy(), nb.to_numpy()])
            i, _ = _Close(n, sa.to_pylist() + sb.to_pylist(), percent).among(k := np.arange(batch.num_rows), k + batch.num_rows)
            yield batch.select(["a", "b"]).take(pa.array(i % max(batch.num_rows, 1)))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(sketched), "a bigint, b bigint")


def _verified(close: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, tables: Tables) -> DataFrame:
    """Of the pairs (a, b) of nodes, those that link, by their whole sets."""
    ends = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    reps = tables.shared(ends.join(nodes, "node").select("node", F.col("rep").alias("doc_id")))
    few = reps.count() <= BROADCAST_ROWS
    wanted = docs.join(F.broadcast(reps) if few else reps, "doc_id").select("node", "text")

    def make():
        def work(rows):
            keys, off = _sets(*utf8(rows.column(1)), None, size)
            whole, n = _whole(keys, off), np.diff(off)
            view = keys.tobytes()
            # rows of one doc_id may hold several texts: the node's own is known by its hash
            own = whole.view(np.int64) == rows.column(0).to_numpy()
            return {"node": rows.column(0), "members": [view[8 * a : 8 * b] if o else None for a, b, o in zip(off[:-1].tolist(), off[1:].tolist(), own.tolist(), strict=True)]} if len(n) else None

        return work

    sets = tables.shared(map_batches(wanted, ["node", "text"], "node bigint, members binary", make).where("members is not null").dropDuplicates(["node"]))
    members = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}"))

    def linked(batches):
        for batch in batches:
            ma, mb = (batch.column(batch.schema.names.index(c)) for c in ("ma", "mb"))
            hits = []
            for x, y in zip(ma, mb, strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                hits.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return tables.shared(close.join(members("a"), "a").join(members("b"), "b").select("a", "b", "ma", "mb").mapInArrow(tidy(linked), "a bigint, b bigint"))


def _posted(filled: DataFrame, percent: int) -> DataFrame:
    """A posting for each shingle in the prefix of each group, with its reach; copies are one group before anything is posted.

    Groups are collapsed within each task first, so a text that a third of all rows copy is one row a task.
    """
    groups = filled.groupBy("grp").agg(F.min("n").alias("n"), F.any_value("prefix").alias("prefix"))
    # what is left of a set from a shingle on must be percent / (100 + percent) of both sizes together
    reach = F.floor((F.col("n") - F.col("pos")) * F.lit(100 + percent) / F.lit(percent)) - F.col("n")
    return groups.select(F.posexplode("prefix").alias("pos", "token"), "grp", "n").select("token", "grp", "n", reach.cast("bigint").alias("reach"), F.when(F.col("token") < 0, F.pmod("grp", F.lit(16))).otherwise(0).alias("salt"))


def _mark(text: str = "text"):
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (columns doc_id and text), and a mark of its text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _mark().alias("mark"))
    tables = Tables()
    profile = tables.shared(_profile(docs, size, percent))
    filled = profile.where("n > 0")
    classes = tables.shared(filled.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("grp").alias("grp"), F.count("*").alias("copies")))
    nodes = filled.select("node", F.col("doc_id").alias("rep"), "n", "sketch", "fine").join(classes.select("node", "rep"), ["node", "rep"]).dropDuplicates(["node"])

    postings = _posted(filled, percent).repartition("token", "salt").select("token", "grp", "n", "reach").mapInArrow(tidy(_shared_postings), "token bigint, grp bigint, n bigint, reach bigint")
    crowded = classes.groupBy("grp").agg(F.count("*").alias("k"), F.min("n").alias("n")).where("k > 1").select(F.xxhash64(F.lit("group"), "grp").alias("token"), "grp", "n", F.col("n").alias("reach"))
    listed = tables.shared(postings.union(crowded).join(classes.select("grp", "node"), "grp").select("token", "node", "n", "reach"))
    flips = np.random.default_rng(85).integers(-(1 << 62), 1 << 62, STARS).tolist()
    sizes = listed.groupBy("token").agg(F.count("*").alias("m"), F.max(F.col("reach") >= F.col("n")).alias("meets"), *[F.min(F.col("node").bitwiseXOR(F.lit(x))).alias(f"x{i}") for i, x in enumerate(flips)])
    leaders = F.array(*[F.col(f"x{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(flips)])
    sizes = tables.shared(sizes.where("m > 1 AND meets").select("token", "m", F.when(F.col("m") > SMALL, F.array_distinct(leaders)).alias("leaders")))
    lined = tables.shared(listed.join(sizes, "token").select("token", "node", "n", "reach", "m", "leaders"))
    nodes = tables.shared(nodes.join(lined.select("node").distinct(), "node"))
    sketches = nodes.select("node", "n", "sketch")
    pairs_of = _close_pairs(percent)
    small = lined.where(F.col("m") <= SMALL).select("token", "node", "reach").join(sketches, "node").select("token", F.lit(0).alias("salt"), "node", "n", "reach", "sketch", F.col("node").alias("root"), F.lit(False).alias("wide"))
    pairs = small.repartition("token").mapInArrow(tidy(pairs_of), "a bigint, b bigint")
    large = lined.where(F.col("m") > SMALL)
    # a member's leaders are gathered over all its lists first: near copies share most lists, and so their leaders
    stars = large.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("others")).select("node", F.explode("others").alias("other"))
    stars = stars.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = _verified(tables.shared(pairs.union(_starred(stars, sketches, percent)).distinct()), nodes, docs, size, percent, tables)
    roots = components(links, tables)

    placed = tables.shared(large.select("token", "node", "n", "reach").join(roots, "node", "left").select("token", "node", "n", "reach", F.coalesce("root", "node").alias("root")))
    main = placed.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    # lists with one main component are searched as one, so that a pair is met once and not under every shingle it shares
    rest = tables.shared(placed.join(main.select("token", "main"), "token").groupBy(F.col("main").alias("token"), "node", "root", "n").agg(F.max("reach").alias("reach")))
    # the smaller of a pair reaches beyond its own size; who can't is held against those only
    meets, probe = F.col("reach") >= F.col("n"), F.col("root") != F.col("token")
    counted = rest.groupBy("token").agg(F.count("*").alias("m"), F.max(meets & ~probe).alias("main_meets"), F.max(meets).alias("any_meets")).where("any_meets")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rest = rest.join(counted, "token").withColumn("wide", probe & (meets | F.col("main_meets")))
    rest = rest.withColumn("salt", F.explode(F.when(F.col("wide"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod("node", blocks).cast("int")))))
    more = rest.join(nodes.select("node", F.col("fine").alias("sketch")), "node").select("token", "salt", "node", "n", "reach", "sketch", "root", "wide").repartition("token", "salt").mapInArrow(tidy(pairs_of), "a bigint, b bigint")
    more = tables.shared(more.distinct())
    if not more.isEmpty():
        links = links.union(_verified(more, nodes, docs, size, percent, tables))
        roots = components(links, tables)

    named = classes.select("node", "rep").join(roots, "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    tied = named.join(least, "root").select("node", "component_id")
    copied = classes.where("copies > 1").join(roots, "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    ids = tables.shared(tied.union(copied))
    tables.drop_others(profile, ids)
    return profile.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "mark")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component, the rows of the least doc_id, with their own columns.

    Rows of equal doc_id and text leave one; rows without a doc_id stay. What goes is found by id and mark, so texts
    are shuffled only if more rows go than may be broadcast, and for rows that repeat.
    """
    found = shared(join(docs, size, percent))
    gone = shared(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    again = shared(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = packed(docs, "doc_id", "text").select("_row", F.col("doc_id").alias("_id"), _mark().alias("_mark"))

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    left = rows.join(bounded(gone), ["_id", "_mark"], "left_anti")
    if not again.isEmpty():
        ids = bounded(again)
        twice = left.join(ids, ["_id", "_mark"], "left_semi").withColumn("_text", F.col("_row.text")).dropDuplicates(["_id", "_text"]).drop("_text")
        left = left.join(ids, ["_id", "_mark"], "left_anti").unionByName(twice)
    return unpacked(left, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("mark")


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS p FROM docs)),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
sets AS (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS c FROM sh GROUP BY r),
classes AS (SELECT c, min(r) AS rep FROM sets GROUP BY c),
one AS (SELECT sh.r, s, n FROM sh JOIN sizes USING (r) WHERE r IN (SELECT rep FROM classes)),
pairs AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM one a JOIN one b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 85 * (nx + ny - o) UNION SELECT y, x FROM pairs WHERE 100 * o >= 85 * (nx + ny - o)),
reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
ids AS (SELECT sets.c, min(d.doc_id) AS id FROM sets JOIN docs d USING (r) GROUP BY sets.c),
least AS (SELECT reach.x, min(i.id) AS component_id FROM reach JOIN classes k ON k.rep = reach.y JOIN ids i ON i.c = k.c GROUP BY reach.x)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, docs.doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN sets USING (r) LEFT JOIN classes USING (c) LEFT JOIN least ON least.x = classes.rep
"""
