"""SentencePiece encoding and decoding (a public BPE model with byte fallback) by suffix-array matching.

Encoding. A text gets a leading mark, spaces become marks, and it is cut into units where no piece can lie across:
before each run of marks and around line feeds. The units of a batch that the task has not met before are
concatenated and their suffix array is built, to the depth of the longest piece, from characters packed into 64-bit
keys. Every piece is binary-searched for its range of occurrences. The occurrences are the edges; sorted
by position they give, for each place, the lengths of the pieces that start there. Relaxation then runs over all units
at once: in each round every unit takes the edge of best score, leftmost first, that joins two neighbouring symbols,
until none is left, which is the merge order of the model. Long units are relaxed with a heap instead. Characters in no
piece become their bytes' tokens.

Decoding concatenates the pieces' bytes, turns marks into spaces and drops the leading one.

Cases: null and empty texts have no tokens; a mark (U+2581) in a text decodes to a space, all else decodes to itself;
very long texts are encoded whole; repeated rows are encoded alike; other columns pass through.
The model file is read on the driver only (``MODEL``, a parameter) and its pieces are broadcast.
A task keeps the units it has met, at most ``CACHE_UNITS``; then it begins anew, which changes no result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .kernel import arrow_schema, bound_batches, chunks, lists, table, tidy, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_UNITS = 300_000
LONG_UNIT = 48
BATCH_BYTES = 1 << 20


class Pieces:
    """The model's vocabulary: ids and scores of its pieces, its byte tokens, and all tokens' bytes."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in plain]
        self.ids = np.array(plain, np.int32)
        self.scores = np.array([model.get_score(i) for i in plain])
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        out = [b""] * n
        for i, t in zip(plain, self.text, strict=True):
            out[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.byte_off = np.append(0, np.cumsum([len(x) for x in out]))
        self.single = {t: i for t, i in zip(self.text, plain, strict=True) if len(t) == 1}
        self.many = [k for k, t in enumerate(self.text) if len(t) > 1]
        inner = {c for k in self.many for c in self.text[k]}
        if "\n" in inner or any(MARK in t.lstrip(MARK) for t in self.text):
            raise ValueError("a piece lies across units")


class _Edges:
    """Occurrences of pieces of two or more characters in ``codes`` (0 ends a unit), by position and length."""

    def __init__(self, codes: np.ndarray, alphabet: dict[str, int], pieces: Pieces):
        bits = max(1, len(alphabet).bit_length())
        per = 63 // bits
        known = [k for k in pieces.many if all(c in alphabet for c in pieces.text[k])]
        longest = max((len(pieces.text[k]) for k in known), default=1)
        levels = -(-longest // per)
        padded = np.append(codes, np.zeros(levels * per + 1, np.uint64))
        keys, alive = [], np.ones(len(codes), bool)
        for level in range(levels):
            key = np.zeros(len(codes), np.uint64)
            for j in range(level * per, (level + 1) * per):
                c = padded[j : j + len(codes)] * alive
                alive = c > 0
                key = key << np.uint64(bits) | c
            keys.append(key)
        suffixes = np.argsort(keys[0]) if levels == 1 else np.lexsort(keys[::-1])
        ranked = [k[suffixes] for k in keys]
        low, high = [], []
        for k in known:
            word = [alphabet[c] for c in pieces.text[k][:per]]
            word_key = 0
            for c in word:
                word_key = word_key << bits | c
            free = bits * (per - len(word))
            low.append(word_key << free)
            high.append((word_key + 1 << free) - 1)
        first = np.searchsorted(ranked[0], np.array(low, np.uint64), "left")
        last = np.searchsorted(ranked[0], np.array(high, np.uint64), "right")
        lengths = np.array([len(pieces.text[k]) for k in known], np.int64)
        for i in np.flatnonzero((lengths > per) & (last > first)).tolist():
            a, b, text = int(first[i]), int(last[i]), pieces.text[known[i]]
            for level in range(1, levels):
                part = [alphabet[c] for c in text[level * per : (level + 1) * per]]
                if not part or a == b:
                    break
                key = 0
                for c in part:
                    key = key << bits | c
                free = bits * (per - len(part))
                view = ranked[level][a:b]
                a, b = a + int(np.searchsorted(view, np.uint64(key << free), "left")), a + int(np.searchsorted(view, np.uint64((key + 1 << free) - 1), "right"))
            first[i], last[i] = a, b
        counts = last - first
        where = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        position = suffixes[where]
        piece = np.repeat(np.array(known, np.int64), counts)
        length = np.repeat(lengths, counts)
        order = np.argsort(position * 64 + length)
        self.piece = piece[order]
        self.begin = np.append(0, np.cumsum(np.bincount(position, minlength=len(codes))))
        self.lengths = np.zeros(len(codes), np.uint64)
        np.bitwise_or.at(self.lengths, position, np.uint64(1) << length.astype(np.uint64))
        self.scores = pieces.scores[self.piece] if len(self.piece) else np.zeros(0)

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the edges of given start and length, -1 where there is none."""
        bit = np.uint64(1) << np.minimum(length, 63).astype(np.uint64)
        have = self.lengths[start]
        at = self.begin[start] + np.bitwise_count(have & (bit - np.uint64(1)))
        return np.where(have & bit > 0, at, -1)


def _relax(edges: _Edges, start: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the final symbols of units, whose characters begin as symbols of their own."""
    length = np.ones(len(start), np.int64)
    done_start, done_length = [], []

    def scores(at: np.ndarray) -> np.ndarray:
        """Score of joining each symbol to its right neighbour."""
        out = np.full(len(at), -np.inf)
        ok = at + 1 < len(start)
        ok[ok] = unit[at[ok]] == unit[at[ok] + 1]
        k = at[ok]
        e = edges.find(start[k], length[k] + length[k + 1])
        out[ok] = np.where(e >= 0, edges.scores[e] if len(edges.scores) else -np.inf, -np.inf)
        return out

    gain = scores(np.arange(len(start)))
    while len(start):
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.maximum.reduceat(gain, heads)
        sizes = np.diff(np.append(heads, len(start)))
        going = best > -np.inf
        if not going.all():
            keep = np.repeat(going, sizes)
            done_start.append(start[~keep])
            done_length.append(length[~keep])
            start, length, unit, gain = start[keep], length[keep], unit[keep], gain[keep]
            best, sizes = best[going], sizes[going]
            if not len(start):
                break
        hits = np.flatnonzero(gain == np.repeat(best, sizes))
        hits = hits[np.append(True, unit[hits[1:]] != unit[hits[:-1]])]
        length[hits] += length[hits + 1]
        stay = np.ones(len(start), bool)
        stay[hits + 1] = False
        now = np.cumsum(stay) - 1
        start, length, unit, gain = start[stay], length[stay], unit[stay], gain[stay]
        changed = now[hits]
        changed = np.unique(np.concatenate([changed, np.maximum(changed - 1, 0)]))
        gain[changed] = scores(changed)
    start, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_start, done_length))
    order = np.argsort(start)
    return start[order], length[order]


def _relax_long(edges: _Edges, begin: int, end: int) -> tuple[list[int], list[int]]:
    """The same for one long unit, by a heap of candidate joins."""
    n = end - begin
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    length = [1] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: np.ndarray | list[int]) -> None:
        i = [x for x in i if x >= 0 and length[x] and following[x] < n]
        both = [length[x] + length[following[x]] for x in i]
        for x, y, e in zip(i, both, edges.find(np.array(i, np.int64) + begin, np.array(both, np.int64)).tolist() if i else [], strict=True):
            if e >= 0:
                heapq.heappush(heap, (-edges.scores[e], x, length[x], y))

    offer(list(range(n)))
    while heap:
        _, i, own, both = heapq.heappop(heap)
        j = following[i]
        if length[i] != own or j >= n or own + length[j] != both:
            continue
        length[i], length[j] = both, 0
        following[i] = following[j]
        if following[i] < n:
            previous[following[i]] = i
        offer([previous[i], i])
    at = [i for i in range(n) if length[i]]
    return [begin + i for i in at], [length[i] for i in at]


class Encoder:
    UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.off = np.zeros(1, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Append the tokens of new units."""
        p = self.pieces
        text = "\0".join(units) + "\0"
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        chars = {c: i + 1 for i, c in enumerate(sorted(set(text) & p.single.keys() - {"\0"}))}
        shown, where = np.unique(raw, return_inverse=True)
        codes = np.array([chars.get(chr(c), 0) for c in shown.tolist()], np.uint64)[where]
        edges = _Edges(codes, chars, p)
        inside = np.ones(len(raw), bool)
        inside[begin + sizes] = False
        unit = np.repeat(np.arange(len(units)), sizes + 1)
        long = np.flatnonzero(sizes > LONG_UNIT)
        short = inside & ~np.isin(unit, long)
        at = np.flatnonzero(short)
        start, length = _relax(edges, at, unit[at])
        if len(long):
            more = [_relax_long(edges, int(begin[u]), int(begin[u] + sizes[u])) for u in long]
            start = np.concatenate([start, *[np.array(s, np.int64) for s, _ in more]])
            length = np.concatenate([length, *[np.array(x, np.int64) for _, x in more]])
            order = np.argsort(start)
            start, length = start[order], length[order]
        tokens = np.full(len(start), -1, np.int32)
        joined = length > 1
        if joined.any():
            tokens[joined] = p.ids[edges.piece[edges.find(start[joined], length[joined])]]
        alone = np.array([p.single.get(chr(c), -1) for c in shown.tolist()], np.int32)
        tokens[~joined] = alone[where[start[~joined]]]
        owner = unit[start]
        spelled = np.flatnonzero(tokens < 0)
        if len(spelled):
            as_bytes = [np.frombuffer(chr(raw[start[i]]).encode(errors="replace"), np.uint8) for i in spelled.tolist()]
            times = np.ones(len(tokens), np.int64)
            times[spelled] = [len(x) for x in as_bytes]
            first = np.cumsum(times) - times
            tokens, owner = np.repeat(tokens, times), np.repeat(owner, times)
            for i, x in zip(first[spelled].tolist(), as_bytes, strict=True):
                tokens[i : i + len(x)] = p.byte_ids[x]
        self.tokens = np.append(self.tokens, tokens)
        self.off = np.append(self.off, self.off[-1] + np.cumsum(np.bincount(owner, minlength=len(units))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and their number by text."""
        if len(self.known) > CACHE_UNITS:
            self.reset()
        known, before = self.known, len(self.known)
        found = [self.UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        numbers = np.array([known.setdefault(u, len(known)) for f in found for u in f], np.int64)
        if len(known) > before:
            self._learn(list(known)[before:])
        size = np.diff(self.off)[numbers]
        ids = self.tokens[np.repeat(self.off[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)]
        return ids, np.diff(ends)


def decode(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of each text from its ids."""
    size = np.diff(pieces.byte_off)[ids]
    flat = pieces.bytes[np.repeat(pieces.byte_off[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
    return [flat[a + 1 if flat[a : a + 1] == b" " else a : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_texts(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """Columns ``keep`` (all, if None), ``n_tokens``, ``ids`` and, with ``check``, ``decoded_ok``: whether decoding gives the text again."""
    own = ["n_tokens", "ids", "decoded_ok"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, docs[text_col].alias("_text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "_text"] + T.StructType.fromDDL("n_tokens bigint, ids array<int>" + ", decoded_ok boolean" * check).fields)
    out = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches):
        encoder = Encoder(shared.value)
        for rows in batches:
            texts = rows.column(rows.schema.names.index("_text"))
            for i, j in chunks(utf8(texts)[1], BATCH_BYTES):
                part, some = rows.slice(i, j - i), texts.slice(i, j - i).to_pylist()
                ids, counts = encoder.encode(some)
                new = {"n_tokens": pa.array(counts, pa.int64()), "ids": lists(ids, counts, pa.int32())}
                if check:
                    new["decoded_ok"] = pa.array([a == (b or "").replace(MARK, " ").encode() for a, b in zip(decode(shared.value, ids, counts), some, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else part.column(part.schema.names.index(f.name)) for f in out], schema=out)

    return source.mapInArrow(tidy(run), schema)


def decode_texts(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns and the decoded text; null ids decode to null."""
    source = encoded.drop(text_col)
    schema = T.StructType([*source.schema.fields, T.StructField(text_col, T.StringType())])
    out = arrow_schema(schema)
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches):
        for rows in batches:
            column = rows.column(rows.schema.names.index(ids_col))
            some = [np.array(x or [], np.int64) for x in column.to_pylist()]
            texts = decode(shared.value, np.concatenate([*some, np.zeros(0, np.int64)]), np.array([len(x) for x in some], np.int64))
            texts = [None if x is None else t.decode(errors="replace") for x, t in zip(column.to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], schema=out)

    return source.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])
