"""Secret scans with a recursive decoding worklist.

Layer 0 is the text. Each layer is scanned with the base patterns; its encoded regions (percent escapes,
Unicode escapes, base64, and the compressed bytes that base64 or percent escapes may hold: gzip, zlib, bzip2, xz,
Zstandard, of any number of members) are decoded into new layers, with all the text around them that a find or an encoding
could run on over (``reach``), so that a keyword beside an encoded value counts and no value is cut. Regions that lie
within each other's reach are decoded together, so a level of the worklist is linear in the text.
A layer's map gives, for every character, the span of layer 0 that it comes from, so a find in any layer
is reported at its place in the text. The worklist ends when no layer is new; a layer whose characters and
place were seen before is not taken up again, which also ends cycles. An escape of an escape sign (``%2525`` and so on) is
unwrapped in one step.

Base64 is decoded at all four alignments of each run of its characters, and what is readable there is a region: a
payload counts wherever it begins, as behind the path of a URL. Compressed bytes are inflated and scanned block by block to
their end, blocks of one blank in bulk; what grows by more than ``MAX_RATIO``, as only bombs within bombs do, is left and
counted as ``n_unread``. Two bytes that begin a zlib stream are tried wherever they are aligned: what isn't one doesn't inflate.

Base patterns (leftmost, without overlap, failing matches dropped): assign, access, hex. A find in a decoded
layer is added under its kind unless it takes nothing from decoded characters, or an equal span is there.

Cases: null and empty texts have no spans; rows are independent, so repeated ids and rows stay; very long
texts are scanned whole; other columns pass through ``scan``, whose own columns replace columns of the same name.
"""

from __future__ import annotations

import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from binascii import a2b_base64
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import arrow_schema, bound_batches, chunks, packed, table, tidy, unpacked, utf8

#: Inflated bytes are taken up by blocks of this size, and by no more than so many for each encoded byte: twice what bzip2, the
#: densest, can give in one layer (at least ``LEAST_RATIO_BYTES``).
BLOCK, MAX_RATIO, LEAST_RATIO_BYTES = 1 << 20, 2_000_000, 64 << 20
KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 24 or more is what the pattern of one or more finds and keeps.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Holds every access or hex find, and every base64 token that can hold a whole find: the shortest takes 12 bytes, so 16 characters.
LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Such a run, or lines of 60 or more that a last one follows.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{16,}")
#: What decoded base64 holds if it is text: as many characters as the shortest find.
READABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]{12,}")
PERCENT = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
PERCENT_RUN = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\+(?:u005[cC])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
#: How compressed bytes begin, and the same with some bytes as percent escapes.
PACKED = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
PACKED_PERCENT = re.compile(r"%1[fF]%8[bB]|(?:\(|%28)%[bB]5|BZh|%[fF][dD](?:7|%37)|(?:x|%78)(?:%01|\^|%5[eE]|%9[cC]|%[dD][aA])")
#: Characters of keywords, values and encodings, and those that may stand between a keyword and its value.
INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-%\\{}")
BETWEEN = frozenset(" \"':")
#: Ends of what no find, and no encoded part of one, lies across: a character of neither set, or a space with no sign beside it.
_CUT = re.compile(r"""[^\s%\\:=]\x20(?=[^\s%\\:="'])|[^A-Za-z0-9+/_.=%\\{}\x20"':-]""")
_BLANK = b" \t\r\n"
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]+")
_KEYWORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Finds of the base patterns as (start, kind, end)."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class _Zstd:
    """Zstandard's streams with the limits on output that the other decompressors have: input is fed by a few blocks."""

    eof, unused_data = False, b""

    def __init__(self):
        import zstandard

        self.inner, self.errors = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), zstandard.ZstdError
        self.unconsumed_tail = b""

    def decompress(self, data: bytes, _: int) -> bytes:
        try:
            out = self.inner.decompress(data[:64])
        except self.errors as e:
            raise zlib.error(str(e)) from e
        self.eof = self.inner.eof
        self.unused_data = self.inner.unused_data + data[64:] if self.eof else b""
        self.unconsumed_tail = b"" if self.eof else data[64:]
        return out


def _opened(head: bytes):
    if head.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if head.startswith(b"\x28\xb5"):
        return _Zstd()
    if head.startswith(b"BZ"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head.startswith(b"\xfd7") else zlib.decompressobj(15)


class Inflated:
    """Blocks of the bytes that ``source`` packs, member by member, and of what those pack in turn; ``left``: bytes behind the last member."""

    def __init__(self, source: Iterator[bytes], most: int):
        self.source, self.most, self.left, self.cut = source, most, 0, False

    def blocks(self) -> Iterator[bytes]:
        blocks = self._members()
        first = next(blocks, b"")
        while 0 < len(first) < 16 and (more := next(blocks, b"")):
            first += more

        def rest():
            yield first
            yield from blocks

        if PACKED.match(first):
            inner = Inflated(rest(), self.most)
            yield from inner.blocks()
            self.cut |= inner.cut
        elif first:
            yield from rest()

    def _members(self) -> Iterator[bytes]:
        d, total = None, 0
        try:
            for data in self.source:
                waiting = False
                while data or waiting:
                    if d is None:
                        if not PACKED.match(data):
                            self.left = len(data)
                            return
                        d = _opened(data)
                    out = d.decompress(data, BLOCK)
                    total += len(out)
                    if out:
                        yield out
                    if total > self.most:
                        self.cut = True
                        return
                    if d.eof:
                        data, waiting, d = d.unused_data, False, None
                    elif hasattr(d, "needs_input"):
                        data, waiting = b"", not d.needs_input
                    else:
                        data = d.unconsumed_tail
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return


def _texts(blocks: Iterator[bytes]) -> Iterator[str]:
    """Text of the blocks in parts that no find or encoding lies across; ends where they aren't text."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for block in blocks:
        if block[0] in _BLANK and block.count(block[:1]) == len(block):
            # a run of one blank is no longer than its first for any find
            if held.endswith(block[:1].decode()) and not decoder.getstate()[0]:
                continue
            block = block[:1]
        text = decoder.decode(block)
        if 20 * sum(map(len, _ODD.findall(text))) > len(text):
            return
        fresh, held, size, at = max(len(held) - 2, 0), held + text, 4096, 0
        while not at and size < 2 * (len(held) - fresh):
            low = max(fresh, len(held) - size)
            at, size = max((m.end() for m in _CUT.finditer(held, low)), default=0), 2 * size
        if at:
            yield held[:at]
            held = held[at:]
        elif len(held) > 16 * BLOCK:
            # one run of that length: its halves overlap by more than any find needs
            yield held
            held = held[-(1 << 16) :]
    if held:
        yield held


class Layer:
    """Decoded text; character i is from ``start[i]`` to ``end[i]`` of layer 0 (neither ever falls), ``coded`` sums the encoded ones."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, plain: np.ndarray):
        self.text, self.start, self.end = text, start, end
        self.coded = np.append(0, np.cumsum(~plain))


def _run(text: str, at: int, stop: int, kind: frozenset) -> int:
    """Where the run of ``kind`` ends that begins at ``at`` and goes towards ``stop``, on either side."""
    if at <= stop:
        while at < stop and text[at] in kind:
            at += 1
    else:
        while at > stop and text[at - 1] in kind:
            at -= 1
    return at


def reach(text: str, at: int, stop: int) -> int:
    """How far a find or an encoding that takes in the region beside ``at`` can go towards ``stop``.

    That is the run of inner characters, what may stand between keyword and value, the run behind that, and so on as
    long as a colon or equals sign joins the runs. The region itself may be what joins the first two.
    """
    step = 1 if at <= stop else -1

    def beside(i: int) -> str:
        """The character met next from ``i`` on."""
        return "" if i == stop else text[i if step > 0 else i - 1]

    at, first, last = _run(text, at, stop, INNER), True, ""
    while True:
        over = _run(text, at, stop, BETWEEN)
        if over == at or not (first or last == "=" or beside(over) == "=" or ":" in text[min(at, over) : max(at, over)]):
            return at
        at, first = _run(text, over, stop, INNER), False
        if at == over:
            return at
        last = text[at - 1 if step > 0 else at]


#: A decoded piece: its text, and where it is from.
Piece = tuple[str, int, int]


def _percent(text: str) -> Iterator[Piece]:
    for run in PERCENT_RUN.finditer(text):
        signs = list(PERCENT.finditer(text, run.start(), run.end()))
        raw = bytes(int(m.group()[-2:], 16) for m in signs)
        try:
            at = 0
            for c in raw.decode():
                n = len(c.encode())
                yield c, signs[at].start(), signs[at + n - 1].end()
                at += n
        except UnicodeDecodeError:
            yield raw.decode(errors="replace"), run.start(), run.end()


def _escapes(text: str) -> Iterator[Piece]:
    for m in ESCAPE.finditer(text):
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        yield (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"), m.start(), m.end()


def _runs(text: str) -> Iterator[tuple[str, np.ndarray | int]]:
    """Runs of base64 characters in the plain alphabet, and the place of each character (or of the first)."""
    for m in BASE64.finditer(text):
        body = m.group()
        places = m.start()
        if "\n" in body:
            kept = [i for i, c in enumerate(body) if c not in "\r\n"]
            body, places = "".join(body[i] for i in kept), np.array(kept) + m.start()
        yield body.replace("-", "+").replace("_", "/"), places


def _decoded(body: str, shift: int) -> bytes:
    use = body[shift:]
    use = use[: len(use) - (len(use) % 4 == 1)]
    return a2b_base64(use + "=" * (-len(use) % 4))


def _base64(text: str, shift: int) -> Iterator[Piece]:
    """Readable stretches of the runs, decoded from their character number ``shift`` on."""
    for body, places in _runs(text):
        data = _decoded(body, shift)
        shown = data.decode("utf-8", "surrogateescape")
        for m in READABLE.finditer(shown):
            a = len(shown[: m.start()].encode("utf-8", "surrogateescape"))
            b = a + len(m.group().encode())
            first, last = shift + 4 * a // 3, min(shift + -(4 * b // -3), len(body)) - 1
            yield (m.group(), int(places[first]), int(places[last]) + 1) if isinstance(places, np.ndarray) else (m.group(), places + first, places + last + 1)


def _packed_regions(text: str) -> Iterator[tuple[bytes, int, np.ndarray | None, int]]:
    """Compressed bytes in base64 or percent escapes: the bytes to the end of their run, where they begin, and the places of a run's characters from there on."""
    for body, places in _runs(text):
        places = places if isinstance(places, np.ndarray) else np.arange(places, places + len(body))
        for shift in range(4):
            data = _decoded(body, shift)
            for m in PACKED.finditer(data):
                at = shift + m.start() // 3 * 4
                # payloads begin with a whole group
                if m.start() % 3 == 0:
                    yield data[m.start() :], int(places[at]), places[at:], 0
    if "%" in text:
        for m in PACKED_PERCENT.finditer(text):
            end = re.compile(r"\S*").match(text, m.start()).end()
            data = unquote_to_bytes(text[m.start() : end])
            if PACKED.match(data):
                yield data, m.start(), None, end


def _layer(outer: Layer | None, text: str, left: int, pieces: list[Piece], right: int) -> Layer:
    """Text from left to right with the pieces in their places."""
    parts, start, end, plain, at = [], [], [], [], left
    for decoded, a, b in (*pieces, ("", right, right)):
        gap = np.arange(at, a)
        n = len(decoded)
        parts += [text[at:a], decoded]
        start += [gap, np.full(n, a)]
        end += [gap + 1, np.full(n, b)]
        plain += [np.ones(len(gap), bool), np.zeros(n, bool)]
        at = max(a, b)
    start, end, plain = np.concatenate(start), np.concatenate(end), np.concatenate(plain)
    if outer is not None:
        # what an outer layer decoded is decoded here too
        plain &= outer.coded[end] == outer.coded[start]
        start, end = outer.start[start], outer.end[np.maximum(end - 1, 0)]
    return Layer("".join(parts), start, end, plain)


def _layers(outer: Layer | None, text: str, unread: list[int]) -> Iterator[Layer]:
    """All next layers of a text."""
    ways = [_percent(text)] if "%" in text else []
    ways += [_escapes(text)] if "\\" in text else []
    some = LONG.search(text)
    ways += [_base64(text, k) for k in range(4)] if some else []
    for way in ways:
        group: list[Piece] = []
        left = 0
        for piece in way:
            if group:
                end, start = group[-1][2], piece[1]
                if reach(text, end, start) < start and reach(text, start, end) > end:
                    yield _layer(outer, text, left, group, reach(text, end, start))
                    group, left = [], reach(text, start, end)
            else:
                left = reach(text, piece[1], 0)
            group.append(piece)
        if group:
            yield _layer(outer, text, left, group, reach(text, group[-1][2], len(text)))
    for data, start, places, end in _packed_regions(text) if some or "%" in text else ():
        inflated = Inflated(iter([data]), max(LEAST_RATIO_BYTES, MAX_RATIO * len(data)))
        for number, part in enumerate(_texts(inflated.blocks())):
            if places is not None:
                # by base64 the last byte that was taken gives the end; it is known once all members have been read
                used = min(-(4 * (len(data) - inflated.left) // -3), len(places))
                end = int(places[used - 1]) + 1
            yield _layer(outer, text, start if number else reach(text, start, 0), [(part, start, end)], end if number else reach(text, end, len(text)))
        unread[0] += inflated.cut


def find(text: str, unread: list[int] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each sorted, as (start, kind, end); adds to ``unread`` the layers not read to their end."""
    base = sorted(base_spans(text))
    if not (LONG.search(text) or "%" in text or "\\" in text):
        return base, base
    unread = [0] if unread is None else unread
    found, seen = set(base), set()
    todo = [_layers(None, text, unread)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        key = (hashlib.blake2b(layer.text.encode(errors="replace"), digest_size=16).digest(), int(layer.start[0]), int(layer.end[-1]))
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(layer.text):
            if layer.coded[b] > layer.coded[a]:
                found.add((int(layer.start[a]), kind, int(layer.end[b - 1])))
        todo.append(_layers(layer, layer.text, unread))
    return base, sorted(found)


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by a mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:] if spans else text


OWN = "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, n_unread bigint"


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Columns ``keep`` (all, if None), counts by kind, base spans and all spans; with ``redacted``, the text without them."""
    own = [x.split()[0] for x in OWN.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    from pyspark.sql import types as T

    schema = T.StructType([f for f in source.schema.fields if f.name != "_text"] + T.StructType.fromDDL(OWN).fields)
    out = arrow_schema(schema)

    def run(batches):
        for rows in batches:
            texts = rows.column(rows.schema.names.index("_text"))
            for i, j in chunks(utf8(texts)[1]):
                part = rows.slice(i, j - i)
                columns: dict[str, list] = {c: [] for c in own}
                clean = []
                for text in texts.slice(i, j - i).to_pylist():
                    unread = [0]
                    base, spans = find(text or "", unread)
                    for k, c in enumerate(own[:3]):
                        columns[c].append(sum(x[1] == k for x in base))
                    columns["base_spans"].append(_text(base))
                    columns["spans"].append(_text(spans))
                    columns["n_unread"].append(unread[0])
                    if redacted:
                        clean.append(text if text is None else redact(text, spans))
                new = {c: pa.array(v, out.field(c).type) for c, v in columns.items()}
                if redacted:
                    new[text_col] = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.names.index(f.name)) for f in out], schema=out)

    return source.mapInArrow(tidy(run), schema)


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents, with their own columns; secrets in the text are redacted."""
    found = scan(packed(docs, text_col), text_col=text_col, redacted=True)
    return unpacked(found, docs.columns, **{text_col: text_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_unread")
