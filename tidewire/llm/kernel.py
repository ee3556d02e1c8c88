"""Vectorised text kernels on UTF-8 batches, shared by the Arrow-batched operators.

A batch of texts is laid out as one byte buffer in which every document is followed by one
separator byte. Words, hashes and shingles of all documents are then found by numpy over the whole
buffer, so the cost per document is a few microseconds and memory is bounded by ``CHUNK_BYTES``
(or by one document, if it is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Batch:
    """Words of some documents: ``starts``, ``ends`` and ``hashes`` of all words, and ``word_off`` by document."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: bytes | None = None, spaces: np.ndarray = SPACES):
        view = raw.tobytes()
        data = b"\n".join([view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]) + b"\n"
        self.n = len(off) - 1
        self.data = data.translate(table) if table else data
        self.buf = np.frombuffer(self.data, np.uint8)
        self.begin = off[:-1] + np.arange(self.n)
        self.end = off[1:] + np.arange(self.n)
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = ~spaces[self.buf]
        inside[1 + self.end] = 0
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.word_off = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.counts = np.diff(self.word_off)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = _power_tables(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_TABLE[self.buf] * power[: len(self.buf)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.span_hashes(self.starts, self.ends)
        return self._hashes

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``k`` words that lies in one document."""
        h = self.hashes
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = h[:m]
        for j in range(1, k):
            acc = mix(acc + np.uint64(j)) + h[j : j + m]
        left = np.repeat(self.word_off[1:], self.counts)[:m] - np.arange(m)
        at = np.flatnonzero(left >= k)
        return at, mix(acc[at])

    def words(self, i: int) -> list[bytes]:
        a, b = self.word_off[i], self.word_off[i + 1]
        return [self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def whole_hash(h: np.ndarray) -> int:
    """Hash of a sequence of word hashes, other than any window's."""
    acc = 0xD6E8FEB86659FD93 + len(h)
    for x in h.tolist():
        acc = (acc * 0xA0761D6478BD642F + x) & (1 << 64) - 1
    return int(mix(np.array([acc], np.uint64))[0])


#: Arrow batches end at about this size: both sides of the pipe to Python hold a few of them, outside the heap.
ARROW_BYTES = 4 << 20


def bound_batches(spark) -> None:
    """Lower the session's limit on an Arrow batch to ``ARROW_BYTES``, if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def tidy(run: Callable) -> Callable:
    """Give a task's memory back when it ends: idle workers share an executor's limit with busy ones."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return released


def map_batches(df: DataFrame, columns: list[str], schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply ``make()``'s function to slices of ``df[columns]``; a column named text bounds a slice's bytes.

    ``make`` runs once in a task. Its function gets a RecordBatch and returns columns by name.
    """
    out = arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches):
        work = make()
        for batch in batches:
            sized = next((c for c in ("text", "html") if c in batch.schema.names), None)
            if sized is None:
                ranges = [(0, batch.num_rows)]
            else:
                ranges = chunks(utf8(batch.column(batch.schema.names.index(sized)))[1], limit)
            for i, j in ranges:
                got = work(batch.slice(i, j - i))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, got[f.name]) for f in out)], schema=out)

    return df.select(*columns).mapInArrow(tidy(run), schema)


def arrow_schema(schema) -> pa.Schema:
    """Arrow's schema of a DDL string or struct type."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def with_fields(df: DataFrame, keep: list[str], added: str) -> StructType:
    """The schema of some columns of ``df`` followed by added ones."""
    return StructType([f for f in df.schema.fields if f.name in keep] + StructType.fromDDL(added).fields)


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values and lengths."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *apart: str) -> DataFrame:
    """``_row`` with all columns as they are, and beside it those named: added names can't clash with a table's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *apart)


def unpacked(df: DataFrame, columns: list[str], **changed: str) -> DataFrame:
    """The columns of ``_row`` in order, those in ``changed`` taken from another column."""
    return df.select(*[(F.col(changed[c]) if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in columns])


def fold(column: str, n: int):
    """crc32 of an id's text, modulo ``n``; a null id has the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark) -> str:
    """A new folder under the cluster's checkpoint folder. Only a local master, whose tasks share its disk, may do without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once, as a table in the shared folder, and read from there."""
    return Tables().shared(df)


class Tables:
    """Tables in the shared folder, and their removal when only a few of them are still read."""

    def __init__(self):
        self.paths: list[tuple[DataFrame, str]] = []

    def shared(self, df: DataFrame) -> DataFrame:
        bound_batches(df.sparkSession)
        path = shared_folder(df.sparkSession)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``; nothing that is still to run may read them."""
        for df, path in [x for x in self.paths if not any(x[0] is k for k in kept)]:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = [x for x in self.paths if any(x[0] is k for k in kept)]
