"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned over all documents.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Each task
hashes the windows of its documents with numpy, looks them up, and verifies every hit word by word.

Cases: a null or empty text has no words and is clean; an item without words has no window, and one without an id
has the id ""; repeated
rows and ids are judged row by row; an empty benchmark leaves every document clean; other columns of
the documents pass through ``decontaminate`` untouched, and of the benchmark only the two named
columns are read. Windows are broadcast in blocks of at most ``BLOCK_BYTES`` of item text, checked before
they are gathered; more blocks are further passes in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import CHUNK_BYTES, LOWER, Batch, arrow_schema, bound_batches, chunks, packed, table, tidy, unpacked, utf8

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Letters a-z, digits and bytes of non-ASCII characters make words.
SEPARATORS = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])


class Windows:
    """The windows of some items, packed: by length sorted hashes, a bitmap in front of them, and the word each begins at.

    The items' words stay as the bytes of their texts and two numbers each, so a block takes about six times its text.
    """

    BITS = 22

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        raws = [(text or "").encode() for _, text in items]
        batch = Batch(np.frombuffer(b"".join(raws), np.uint8), np.append(0, np.cumsum([len(r) for r in raws], dtype=np.int64)), LOWER, SEPARATORS)
        self.data, self.starts, self.ends, self.word_off = batch.data, batch.starts.astype(np.uint32), batch.ends.astype(np.uint32), batch.word_off
        self.lengths = []
        for k in np.unique(np.minimum(batch.counts, window)).tolist():
            if not k:
                continue
            at, h = batch.windows(k)
            if k < window:
                # only items of just so many words have windows of that length
                own = np.isin(at, batch.word_off[:-1][batch.counts == k])
                at, h = at[own], h[own]
            order = np.argsort(h, kind="stable")
            keys = h[order]
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.lengths.append((k, np.packbits(bitmap, bitorder="little"), keys, at[order].astype(np.uint32)))

    def _word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def scan(self, batch: Batch) -> tuple[list, list, list]:
        """By document: spans of hit words (start, end of the word numbers) and the items they are from."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.n)]
        items: list[set[str]] = [set() for _ in range(batch.n)]
        for k, bitmap, keys, places in self.lengths:
            at, h = batch.windows(k)
            bucket = h >> np.uint64(64 - self.BITS)
            maybe = np.flatnonzero(bitmap[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1)
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            hit = np.flatnonzero(high > low)
            for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                words = [batch.data[batch.starts[p + i] : batch.ends[p + i]] for i in range(k)]
                same = [q for q in places[a:b].tolist() if all(self._word(q + i) == w for i, w in enumerate(words))]
                if same:
                    d = int(np.searchsorted(batch.word_off, p, "right")) - 1
                    first = p - int(batch.word_off[d])
                    spans[d].append((first, first + k))
                    items[d].update(self.names[j] for j in (np.searchsorted(self.word_off, same, "right") - 1).tolist())
        return batch.counts, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks of about ``limit`` bytes the items make, and the blocks, each gathered when it is asked for."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-total // limit) or 1
    return n, ([(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).toLocalIterator()] for b in range(n))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``n_words``, ``hit_spans`` (merged word ranges), ``hit_items`` (sorted), ``n_hit``.

    With ``keep`` None all columns stay. The added names replace columns of the same name.
    """
    keep = list(docs.columns) if keep is None else keep
    added = ["n_words", "hit_spans", "hit_items", "n_hit"]
    kept = docs.select(*[F.col(c) for c in keep if c not in added], F.col(text_col).alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]
    extra = T.StructType.fromDDL("n_words bigint, hit_spans array<struct<a: bigint, b: bigint>>, hit_items array<string>, n_hit bigint")
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    n_blocks, blocks = _blocks(benchmark, item_col, "text", block_bytes)
    frame = kept
    for number, block in enumerate(blocks):
        shared = sc.broadcast(Windows(block, window))
        last = number == n_blocks - 1
        schema = T.StructType(fields + extra.fields + ([] if last else [T.StructField("_text", T.StringType())]))
        out = arrow_schema(schema)

        def run(batches, shared=shared, out=out, first=number == 0, last=last):
            windows = shared.value
            for rows in batches:
                raw, off = utf8(rows.column(rows.schema.names.index("_text")))
                for i, j in chunks(off, CHUNK_BYTES):
                    part = rows.slice(i, j - i)
                    counts, spans, items = windows.scan(Batch(raw[off[i] : off[j]], off[i : j + 1] - off[i], LOWER, SEPARATORS))
                    if not first:
                        names = part.schema.names
                        for d, (s, n) in enumerate(zip(part.column(names.index("hit_spans")).to_pylist(), part.column(names.index("hit_items")).to_pylist(), strict=True)):
                            spans[d] += [(x["a"], x["b"]) for x in s]
                            items[d] |= set(n)
                    spans = [_merged(s) if s else s for s in spans]
                    new = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], out.field("hit_spans").type), "hit_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "n_hit": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())}
                    yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.names.index(f.name)) for f in out], schema=out)

        frame = frame.mapInArrow(tidy(run), schema)
    return frame


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    return unpacked(scan(packed(docs, "text"), benchmark, keep=["_row"], **options).where("n_hit = 0"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT r, dw.k, p, item_id FROM dw JOIN win USING (k, s)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
