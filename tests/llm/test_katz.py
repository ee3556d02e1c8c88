"""Katz back-off against plain dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import katz

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, score double, chunk string, n_known string"


class Plain:
    def __init__(self, docs):
        self.uni, self.bi, self.hist, self.documents = Counter(), Counter(), Counter(), 0
        for doc, text in docs:
            if self.held(doc):
                continue
            self.documents += 1
            for h, x in self.split(text):
                self.uni[x] += 1
                self.bi[h, x] += 1
                self.hist[h] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        seen = lambda c: [sum(n == r for n in c.values()) for r in range(1, 7)]
        self.d1, self.d2 = katz.discounts(seen(self.uni)), katz.discounts(seen(self.bi))
        self.p0 = (1 + sum(c * (1 - self.d1[min(c, 6)]) for c in self.uni.values())) / (self.n + 1)
        self.after: dict = {}
        for (h, x), c in self.bi.items():
            self.after.setdefault(h, {})[x] = c

    @staticmethod
    def held(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2

    @staticmethod
    def split(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL)) + [" "]
        return list(zip(["  ", *words[:-1]], words, strict=True))

    def word(self, x):
        return self.uni[x] * self.d1[min(self.uni[x], 6)] / (self.n + 1) if x in self.uni else self.p0

    def weight(self, h):
        if h not in self.after:
            return 1.0
        left = (1 + sum(c * (1 - self.d2[min(c, 6)]) for c in self.after[h].values())) / (self.hist[h] + 1)
        return left / (1 - sum(self.word(x) for x in self.after[h]))

    def p(self, h, x):
        c = self.after.get(h, {}).get(x, 0)
        return c * self.d2[min(c, 6)] / (self.hist[h] + 1) if c else self.weight(h) * self.word(x)

    def row(self, doc, text):
        toks = self.split(text)
        base = sum(math.log10((self.uni[x] + 1) / (self.n + self.v + 1)) for _, x in toks)
        return doc, self.held(doc), len(toks), sum(x in self.uni for _, x in toks), self.n, base, sum(math.log10(self.p(h, x)) for h, x in toks)


def corpus():
    rng = random.Random(11)
    words = [f"W{int(rng.paretovariate(0.9))}" for _ in range(500)] + ["Über", "naïve", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs += [(300 + i, t) for i, t in enumerate([None, "", " \t\n", "license line one two", "x" * 100_000, "a\x0bb\x0cc", "end"])]
    return docs + [(400 + i, "the same licence line in every file") for i in range(60)] + docs[:5] + [(None, "no id")]


def test_scores(spark):
    docs = corpus()
    plain = Plain(docs)
    df = spark.createDataFrame([(d, t, 1.0, "clash", "clash") for d, t in docs], SCHEMA).repartition(5)
    got = sorted(map(tuple, katz.scores(katz._held(df)).collect()), key=repr)
    want = sorted((plain.row(*d) for d in docs), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-12, atol=1e-9)
    assert sum(r[1] for r in got) and any(h in plain.after and x not in plain.after[h] for d, t in docs if plain.held(d) for h, x in plain.split(t))


def test_many_chunks_score_alike(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1.0, "clash", "clash") for d, t in docs], SCHEMA)
    whole = sorted(map(tuple, katz.scores(katz._held(df)).collect()), key=repr)
    monkeypatch.setattr(katz, "CHUNK", 5_000)
    parts = sorted(map(tuple, katz.scores(katz._held(df)).collect()), key=repr)
    assert [r[:5] for r in whole] == [r[:5] for r in parts] and np.allclose([r[5:] for r in whole], [r[5:] for r in parts], rtol=1e-12, atol=1e-9)


def test_every_history_sums_to_one():
    plain = Plain(corpus())
    for h in [*plain.after, "never seen"]:
        assert math.isclose(sum(plain.p(h, x) for x in plain.uni) + plain.p(h, "unknown word"), 1, rel_tol=1e-9)


def test_discounts():
    d = katz.discounts([100, 40, 22, 14, 10, 7])
    a = 6 * 7 / 100
    assert math.isclose(d[1], (2 * 40 / 100 - a) / (1 - a)) and d[6] == 1 and all(0 < x < 1 for x in d[1:6])
    assert all(0 < x < 1 for x in katz.discounts([0] * 6)[1:6]) and all(0 < x < 1 for x in katz.discounts([9, 0, 0, 1, 0, 0])[1:6])


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packing(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    assert (katz.unpacked_keys(katz.packed_keys(keys)) == keys).all() and (katz.unpacked(katz.packed(keys)) == keys).all()


def test_long_texts_are_cut_at_white_space(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two  three\n" * 50, "y" * 300, None, "four " * 9])
    whole = katz.tokens(texts)
    monkeypatch.setattr(katz, "_PIECE", 20)
    parts = katz.tokens(texts)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() == [151, 2, 1, 10]


def test_no_documents_and_none_to_train_on(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert katz.scores(katz._held(none)).collect() == []
    held = next(i for i in range(100) if Plain.held(i))
    (r,) = katz.scores(katz._held(spark.createDataFrame([(held, "a b", 0.0, "", "")], SCHEMA))).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
