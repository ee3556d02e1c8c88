"""Hashed subword features of documents, computed once for each distinct word of a batch."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from .kernel import Batch, mix, utf8

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Distinct words of a batch, the word number of every occurrence, and the characters of all distinct words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: bytes | None = None):
        b = self.batch = Batch(raw, off, table)
        _, first, self.inverse = np.unique(b.hashes, return_index=True, return_inverse=True)
        self.size = len(first)
        self.hashes = b.hashes[first]
        starts, lens = b.starts[first], (b.ends - b.starts)[first]
        # every word stands between a 1 and a 2, which no word of text begins or ends with in practice
        self.off = np.concatenate([[0], np.cumsum(lens + 2)])
        at = np.arange(self.off[-1]) - np.repeat(self.off[:-1], lens + 2)
        last = np.repeat(lens, lens + 2)
        take = np.clip(at - 1, 0, np.maximum(last - 1, 0)) + np.repeat(starts, lens + 2)
        data = np.where(at == 0, 1, np.where(at == last + 1, 2, b.buf[take] if len(b.buf) else 0)).astype(np.uint64)
        # a character is the number that its UTF-8 bytes make
        lead = (data & np.uint64(0xC0)) != np.uint64(0x80)
        first_byte = np.flatnonzero(lead)
        self.chars = data[first_byte]
        for j in (1, 2, 3):
            more = first_byte + j < np.append(first_byte[1:], len(data))
            self.chars[more] = self.chars[more] << np.uint64(8) | data[first_byte[more] + j]
        self.word = np.repeat(np.arange(self.size), lens + 2)[first_byte]
        ends = np.cumsum(np.bincount(self.word, minlength=self.size))
        self.left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(self.chars))

    def grams(self, lengths: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Word number and bucket of each character n-gram of the distinct words, in no particular order."""
        words, buckets = [], []
        for n in lengths:
            m = len(self.chars) - n + 1
            if m <= 0:
                continue
            code = self.chars[:m]
            for j in range(1, n):
                code = code * _STEP + self.chars[j : j + m]
            at = np.flatnonzero(self.left[:m] >= n)
            words.append(self.word[at])
            buckets.append((mix(code[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        return (np.concatenate(words), np.concatenate(buckets)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def word_buckets(self, bits: int) -> np.ndarray:
        return (mix(self.hashes) >> np.uint64(64 - bits)).astype(np.int64)

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and bucket of each pair of neighbouring words, hashed by the difference of their hashes: pairs of one word twice share a bucket."""
        h, doc = self.batch.hashes, self.batch.doc_of_word()
        at = np.flatnonzero(doc[1:] == doc[:-1])
        return doc[at], (mix(h[at + 1] - h[at]) >> np.uint64(64 - bits)).astype(np.int64)

    def document_sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over all words of each document of a figure (or row of figures) of the distinct words."""
        total = np.zeros((len(self.inverse) + 1, *per_word.shape[1:]))
        np.cumsum(per_word[self.inverse], axis=0, out=total[1:])
        return total[self.batch.word_off[1:]] - total[self.batch.word_off[:-1]]


def sparse_counts(texts: list[str], lengths: tuple[int, ...], bits: int, words: bool, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bucket counts: row offsets, sorted buckets, counts. Word buckets follow the n-grams' buckets, then those of word pairs."""
    rows = [0]
    # one growing buffer each, of half the width: thousands of small arrays would leave the driver's memory in pieces
    buckets, counts = array("i"), array("i")
    for text in texts:
        raw, off = utf8(pa.array([text], pa.string()))
        v = Vocabulary(raw, off, table)
        times = np.bincount(v.inverse, minlength=v.size)
        w, g = v.grams(lengths, bits)
        if words:
            w, g = np.concatenate([w, np.arange(v.size)]), np.concatenate([g, v.word_buckets(bits) + (1 << bits)])
        number = times[w]
        if words:
            pairs = v.pairs(bits)[1] + (2 << bits)
            g, number = np.concatenate([g, pairs]), np.concatenate([number, np.ones(len(pairs), np.int64)])
        u, inv = np.unique(g, return_inverse=True)
        buckets.frombytes(u.astype(np.int32).tobytes())
        counts.frombytes(np.bincount(inv, weights=number, minlength=len(u)).astype(np.int32).tobytes())
        rows.append(rows[-1] + len(u))
    return np.array(rows), np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.int32)


def sample(frame, n: int, max_bytes: int, text_col: str = "text"):
    """At most ``n`` rows of at most ``max_bytes`` text in all: those of the least hash of doc_id, gathered on the driver.

    Texts that don't fit are left out whole; no text is cut.
    """
    from pyspark.sql import functions as F

    chosen = frame.orderBy(F.xxhash64(F.lit(17), F.col("doc_id")), F.col("doc_id")).limit(n)
    out, left = [], max_bytes
    for row in chosen.toLocalIterator():
        size = len(row[text_col].encode())
        if size <= left:
            out.append(row)
            left -= size
    return out
