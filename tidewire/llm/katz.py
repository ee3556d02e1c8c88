"""Language-model scores by Katz back-off over words, from counts of all training documents.

Counts r of at most ``LARGE`` are discounted by Good and Turing's estimate, others aren't. What a history's
followers leave goes to the words never seen after it, in proportion to the distribution one order below, so the weights
sum to one exactly. One more count in each history is set aside for those words, so that a history whose followers
are all frequent backs off too. Below the words stands one unknown word, which gets what the words leave.

Texts are dealt into chunks by a hash of the row, the same in both passes. In the first, a chunk tells its distinct n-grams (64-bit
hashes of words and of pairs, sorted) with their training counts to buckets of n-grams. A bucket adds them up, which gives
the rows of the model's table (by order and bucket), and answers each chunk with the counts of its n-grams, in the
order in which it sent them. In the second pass a chunk finds its texts again, scores each token by the longest n-gram
that is known, and tells two things: its share of each history's sums (a pair belongs to the first chunk that holds it), and
the histories of its tokens that back off, whose weights are joined last. So texts move twice, n-grams once for each
chunk that holds them, and nothing grows on the driver. A frequent n-gram is one entry a chunk; histories with more
than 1/1024 of all requests, 1024 at most, have their weights broadcast. A chunk's text, a bucket's n-grams and the
longest word bound a task's memory.

Cases: a null or empty text is its end token; without training documents all scores are 0; equal rows score alike; null
ids are in no held-out fold (the empty text's crc32 is 0); columns beyond ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import LOWER, SPACES, Batch, Tables, arrow_schema, bound_batches, chunks, fold, mix, table, tidy, utf8

#: Bytes of text of a chunk, and of the texts whose n-grams a bucket holds; buckets at least.
CHUNK, BUCKET, BUCKETS = 6 << 20, 32 << 20, 64
#: Counts up to this are discounted.
LARGE = 5
_END, _START = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PIECE = 1 << 22
_GRAMS = "gram int, bucket int, chunk bigint, keys binary, counts binary"
_TOLD = "kind int, chunk bigint, idx bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, key bigint, lower double, spare double, n bigint"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Within it, a written table's shuffles are deleted when it has been written: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lean(work, *given) -> pa.Table:
    """The result of a group's work, with the memory that it took given back."""
    (result,) = tidy(lambda groups: (work(*g) for g in groups))([given])
    return result


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: small ones leave planes of zeros, which compress to nothing."""
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _pieces(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with texts longer than ``_PIECE`` cut at white space, and the text of each piece."""
    cuts, whose = [0], []
    for i in range(len(off) - 1):
        at, end = int(off[i]), int(off[i + 1])
        while end - at > _PIECE:
            probe = at + _PIECE
            while probe < end and not (hit := np.flatnonzero(SPACES[raw[probe : min(end, probe + 65536)]])).size:
                probe += 65536
            if probe >= end:
                break
            at = probe + int(hit[0])
            cuts.append(at)
            whose.append(i)
        cuts.append(end)
        whose.append(i)
    return np.array(cuts, np.int64), np.array(whose, np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and their numbers by text."""
    raw, off = utf8(texts)
    n = len(off) - 1
    cuts, whose = _pieces(raw, off)
    words, counts = [], np.ones(n, np.int64)
    for i, j in chunks(cuts):
        b = Batch(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], LOWER)
        words.append(b.hashes)
        np.add.at(counts, whose[i:j], b.counts)
    out = np.full(int(counts.sum()), _END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return out, counts


def pairs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each one, and the hash of both."""
    before = np.roll(h, 1)
    before[np.cumsum(counts) - counts] = _START
    return before, mix(mix(before + np.uint64(0x9E3779B97F4A7C15)) + h)


def discounts(seen: list[int]) -> np.ndarray:
    """What is left of a count r, for r up to ``LARGE`` and (last) beyond; ``seen`` has the numbers of n-grams of counts 1, 2, ...

    Good and Turing's with the largest bound on r at which all lie between 0 and 1; else, as in tiny corpora, r less a constant.
    """
    out = np.ones(LARGE + 2)
    for large in range(LARGE, 1, -1):
        if all(seen[r - 1] for r in range(1, large + 1)):
            a = (large + 1) * seen[large] / seen[0]
            d = [((r + 1) * seen[r] / (seen[r - 1] * r) - a) / (1 - a) if a != 1 else -1.0 for r in range(1, large + 1)]
            if all(0 < x < 1 for x in d):
                out[1 : large + 1] = d
                return out
    less = (seen[0] + 1) / (seen[0] + 2 * seen[1] + 2)
    out[1 : LARGE + 1] = [1 - less / r for r in range(1, LARGE + 1)]
    return out


@dataclass
class Model:
    """What every task knows of the counts: discounts of words and pairs, training tokens, distinct ones and documents."""

    words: np.ndarray
    pairs: np.ndarray
    tokens: int
    types: int
    unknown: float
    documents: int

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words from their counts."""
        kept = c * self.words[np.minimum(c, LARGE + 1)]
        return np.where(c > 0, kept / (self.tokens + 1), self.unknown)


def _held(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold("doc_id", 7) == 2).alias("held_out"))


def _chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with a chunk, and the number of buckets for their n-grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-size // CHUNK) or 1))
    return docs.withColumn("chunk", chunk), max(BUCKETS, -(-size // BUCKET))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order that sorts all, and where each one's run begins in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order, first


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of the model (chunk -1: an order's and bucket's keys and counts, with how many have each small count) and answers to chunks."""
    asked, out = arrow_schema(_GRAMS), arrow_schema(_GRAMS + ", seen array<bigint>, types bigint, tokens bigint")

    def ask(key, rows):
        h, counts = tokens(rows["text"].combine_chunks())
        trained = np.repeat(~rows["held_out"].to_numpy(), counts).astype(np.uint64)
        told = []
        for gram, keys in ((1, h), (2, pairs(h, counts)[1])):
            distinct, order, first = _distinct(keys)
            sums = np.add.reduceat(trained[order], first) if len(first) else first
            which = _bucket(distinct, buckets)
            bounds = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                told.append((gram, int(which[i]), key[0].as_py(), packed_keys(distinct[i:j]), packed(sums[i:j])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), asked, strict=True)], schema=asked)

    def answer(key, rows):
        rows = rows.sort_by("chunk")
        parts = [unpacked_keys(k.as_py()) for k in rows["keys"]]
        counts = np.concatenate([unpacked(c.as_py()) for c in rows["counts"]])
        bounds = np.cumsum([0, *map(len, parts)])
        keys = np.concatenate(parts)
        del parts
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, first)
        run = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        # the first chunk that counts an n-gram in training owns it
        have = np.flatnonzero(counts)
        owners = have[np.append(True, run[have][1:] != run[have][:-1])] if len(have) else have
        reply = total[run] * np.uint64(2)
        reply[owners] += np.uint64(1)
        back = np.empty_like(reply)
        back[order] = reply
        gram, bucket = key[0].as_py(), key[1].as_py()
        known = total > 0
        seen = np.bincount(np.minimum(total[known], LARGE + 2).astype(np.int64), minlength=LARGE + 3)[1 : LARGE + 2]
        told = [(gram, bucket, -1, packed_keys(keys[first][known]), packed(total[known]), seen.tolist(), int(known.sum()), int(total.sum()))]
        told += [(gram, bucket, c, None, packed(back[i:j]), None, None, None) for c, i, j in zip(rows["chunk"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), out, strict=True)], schema=out)

    rows = docs.groupBy("chunk").applyInArrow(lambda key, rows: _lean(ask, key, rows), _GRAMS)
    return rows.groupBy("gram", "bucket").applyInArrow(lambda key, rows: _lean(answer, key, rows), _GRAMS + ", seen array<bigint>, types bigint, tokens bigint")


def model(grams: DataFrame, documents: int) -> Model:
    """The model's small part, from the table of its n-grams."""
    told = grams.where("chunk = -1").select("gram", "types", "tokens", *[F.col("seen")[i].alias(f"n{i}") for i in range(LARGE + 1)])
    rows = {r.gram: r for r in told.groupBy("gram").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(LARGE + 1)]).collect()}
    seen = {g: [int(rows[g][f"n{i}"]) if g in rows else 0 for i in range(LARGE + 1)] for g in (1, 2)}
    d1, d2 = discounts(seen[1]), discounts(seen[2])
    n, types = (int(rows[1].tokens), int(rows[1].types)) if 1 in rows else (0, 0)
    spare = sum(r * seen[1][r - 1] * (1 - d1[r]) for r in range(1, LARGE + 1))
    return Model(d1, d2, n, types, (1 + spare) / (n + 1), documents)


def _scored(docs: DataFrame, grams: DataFrame, m: Model) -> DataFrame:
    """Of every chunk its documents (kind 0, scores without back-off weights), histories (1) and requests for weights (2)."""
    out = arrow_schema(_TOLD)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def part(kind, chunk, size, **columns):
        arrays = {"kind": pa.array(np.full(size, kind), pa.int32()), "chunk": pa.array(np.full(size, chunk), pa.int64())}
        arrays |= {c: pa.array(v, out.field(c).type) for c, v in columns.items()}
        return pa.Table.from_arrays([arrays.get(f.name, pa.nulls(size, f.type)) for f in out], schema=out)

    def score(key, rows, answers):
        m, chunk = shared.value, key[0].as_py()
        h, counts = tokens(rows["text"].combine_chunks())
        before, both = pairs(h, counts)
        answers = answers.sort_by("bucket")

        def counts_of(gram: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each token's count, and a token for each n-gram that this chunk owns."""
            _, order, first = _distinct(keys)
            mine = answers.filter(pa.compute.equal(answers["gram"], gram))
            reply = np.concatenate([unpacked(x.as_py()) for x in mine["counts"]]) if len(mine) else np.zeros(0, np.uint64)
            each = np.empty(len(keys), np.int64)
            each[order] = np.repeat((reply >> np.uint64(1)).astype(np.int64), np.diff(np.append(first, len(keys))))
            return each, order[first[(reply & np.uint64(1)) == 1]]

        # large arrays go as soon as they have been used
        c2, owned = counts_of(2, both)
        del both
        c1, _ = counts_of(1, h)
        del h, answers
        doc = np.repeat(np.arange(len(counts)), counts)
        history = np.roll(c1, 1)
        history[np.cumsum(counts) - counts] = m.documents
        word = m.word(c1)
        kept = c2 * m.pairs[np.minimum(c2, LARGE + 1)]
        logs = np.log10(np.where(c2 > 0, kept / (history + 1), word))
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(counts))
        told = [part(0, chunk, len(counts), idx=np.arange(len(counts)), doc_id=rows["doc_id"].combine_chunks(), held_out=rows["held_out"].combine_chunks(), n_tokens=counts, n_known=sums(c1 > 0).astype(np.int64), base_score=sums(np.log10((c1 + 1) / (m.tokens + m.types + 1))), score=sums(logs))]
        # histories: what their pairs leave, and the lower distribution's share of their followers
        names, at = np.unique(before[owned], return_inverse=True)
        spare = (c2 - kept)[owned]
        heads = np.zeros(len(names), np.int64)
        heads[at] = history[owned]
        told.append(part(1, chunk, len(names), key=names.view(np.int64), lower=np.bincount(at, weights=word[owned], minlength=len(names)), spare=np.bincount(at, weights=spare, minlength=len(names)), n=heads))
        off = np.flatnonzero((c2 == 0) & (history > 0))
        asked = np.zeros(len(off), [("doc", np.int64), ("key", np.uint64)])
        asked["doc"], asked["key"] = doc[off], before[off]
        asked, n = np.unique(asked, return_counts=True)
        told.append(part(2, chunk, len(asked), idx=asked["doc"], key=asked["key"].astype(np.uint64).view(np.int64), n=n))
        return pa.concat_tables(told)

    answers = grams.where("chunk >= 0").select("chunk", "gram", "bucket", "counts")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, rows, told: _lean(score, key, rows, told), _TOLD)


def weights(told: DataFrame) -> DataFrame:
    """log10 of each history's back-off weight: what its followers leave, over the lower distribution's share of the rest."""
    sums = told.where("kind = 1").groupBy("key").agg(F.sum("lower").alias("lower"), F.sum("spare").alias("spare"), F.max("n").alias("n"))
    return sums.select("key", F.log10((1 + F.col("spare")) / (F.col("n") + 1) / (1 - F.col("lower"))).alias("weight"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all documents; those with ``held_out`` false train."""
    spark, tables = docs.sparkSession, Tables()
    bound_batches(spark)
    docs, buckets = _chunked(docs)
    with _shuffles_dropped(spark):
        grams = tables.shared(counted(docs, buckets))
        m = model(grams, docs.where("not held_out").count())
        told = tables.shared(_scored(docs, grams, m))
        backed = tables.shared(weights(told))
    asked = told.where("kind = 2").select("key", "chunk", "idx", "n")
    total = asked.count()
    heavy = F.broadcast(asked.groupBy("key").count().where(F.col("count") * 1024 > total).select("key"))
    few = F.broadcast(backed.join(heavy, "key", "left_semi"))
    weighed = asked.join(few, "key").unionByName(asked.join(heavy, "key", "left_anti").join(backed, "key"))
    extra = weighed.groupBy("chunk", "idx").agg(F.sum(F.col("n") * F.col("weight")).alias("extra"))
    rows = told.where("kind = 0").select("chunk", "idx", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    rows = rows.join(extra, ["chunk", "idx"], "left")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("bigint").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places, since the order of a sum shows beyond."""
    found = scores(_held(table(spark, sf_dir, "documents")))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _left(name: str, counts: str) -> str:
    """SQL: discounts ``name`` (r, d) of the n-grams' counts in ``counts`` (c)."""
    return f"""{name}n AS (SELECT list(n ORDER BY k) AS n FROM (SELECT k, count(c) AS n FROM (SELECT unnest(range(1, {LARGE + 2})) AS k) LEFT JOIN {counts} ON c = k GROUP BY k)),
{name}k AS (SELECT large, r, ((r + 1) * n[r + 1] / nullif(n[r] * r, 0) - (large + 1) * n[large + 1] / nullif(n[1], 0)) / nullif(1 - (large + 1) * n[large + 1] / nullif(n[1], 0), 0) AS d FROM {name}n, (SELECT unnest(range(2, {LARGE + 1})) AS large), (SELECT unnest(range(1, {LARGE + 1})) AS r) WHERE r <= large),
{name}b AS (SELECT max(large) AS large FROM (SELECT large FROM {name}k GROUP BY large HAVING bool_and(coalesce(d > 0 AND d < 1, false)))),
{name} AS (SELECT r, CASE WHEN b.large IS NULL THEN 1 - (n[1] + 1) / (n[1] + 2 * n[2] + 2) / r WHEN r > b.large THEN 1 ELSE (SELECT d FROM {name}k k WHERE k.large = b.large AND k.r = x.r) END AS d FROM (SELECT unnest(range(1, {LARGE + 1})) AS r) x, {name}n, {name}b b)"""


#: White space stands for the end and the start, which no word can be.
ORACLE = f"""
WITH RECURSIVE g(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents, tab),
tk AS (SELECT r, held_out, unnest(w) AS x, unnest(list_prepend('  ', w[:-2])) AS h FROM docs),
uc AS (SELECT x, count(*) AS c FROM tk WHERE NOT held_out GROUP BY x), bc AS (SELECT h, x, count(*) AS c FROM tk WHERE NOT held_out GROUP BY h, x), hc AS (SELECT h, sum(c) AS c FROM bc GROUP BY h),
{_left("du", "uc")}, {_left("db", "bc")},
tot AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uc),
up AS (SELECT x, c, c * coalesce(d, 1) / (n + 1) AS p FROM uc LEFT JOIN du ON r = c, tot),
unk AS (SELECT (1 + coalesce((SELECT sum(c * (1 - d)) FROM uc JOIN du ON r = c), 0)) / (n + 1) AS p0 FROM tot),
al AS (SELECT h, (1 + sum(bc.c * (1 - coalesce(d, 1)))) / (any_value(hc.c) + 1) / (1 - sum(up.p)) AS a FROM bc LEFT JOIN db ON db.r = bc.c JOIN up USING (x) JOIN hc USING (h) GROUP BY h),
lp AS (SELECT tk.r, coalesce(up.c, 0) AS c, log10(CASE WHEN bc.c IS NOT NULL THEN bc.c * coalesce(db.d, 1) / (hc.c + 1) ELSE coalesce(al.a, 1) * coalesce(up.p, p0) END) AS l FROM tk CROSS JOIN unk LEFT JOIN up USING (x) LEFT JOIN bc ON bc.h = tk.h AND bc.x = tk.x LEFT JOIN db ON db.r = bc.c LEFT JOIN hc ON hc.h = tk.h LEFT JOIN al ON al.h = tk.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((c + 1) / (n + v + 1))), 6) AS base_score, round(sum(l), 6) AS score
FROM lp JOIN docs USING (r), tot GROUP BY r, doc_id, held_out
"""
