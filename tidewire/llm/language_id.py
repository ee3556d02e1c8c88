"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of the words (with their bounds), ASCII letters in lower case; a
document's row is its n-gram counts times inverse document frequency, divided by the sum of that row. Training follows the regularised
leader (FTRL-proximal) with elastic-net penalties, which leaves most weights exactly zero. A temperature, fitted
on a fifth of the sample that the weights have not seen, calibrates the probabilities.

The fit (document frequencies included) uses at most ``TRAIN_ROWS`` rows a language and ``TRAIN_BYTES`` of
whole texts, outside the held-out fold. Prediction covers every row and whole texts.

Cases: a null text or one without a letter is ``und`` with score 0; without any labelled text all are
``und``; with one language every text with a letter is that language with score 1; ties go to the
first language in order; repeated rows are predicted alike; columns beyond ``doc_id``, ``text`` and ``lang``
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import Vocabulary, sample, sparse_counts
from .kernel import LOWER, fold, map_batches, table, utf8, with_fields

TRAIN_ROWS = 600
TRAIN_BYTES = 8 << 20
BITS, LENGTHS = 16, (2, 3, 4)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 4
SCALE = 20.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Model:
    """``weights``: rows by bucket and columns by language, with inverse document frequency multiplied in."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.bias, self.temperature = languages, idf, bias, temperature
        self.table = np.column_stack([weights * idf[:, None] * SCALE, idf])

    def predict(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        raw, off = utf8(texts)
        v = Vocabulary(raw, off, LOWER)
        b = v.batch
        if not self.languages:
            return ["und"] * b.n, np.zeros(b.n)
        w, g = v.grams(LENGTHS, BITS)
        k = len(self.languages)
        words = np.column_stack([np.bincount(w, weights=self.table[g, j], minlength=v.size) for j in range(k + 1)])
        sums = v.document_sums(words) if v.size else np.zeros((b.n, k + 1))
        z = (sums[:, :k] / np.maximum(sums[:, k:], 1e-12) + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        total = np.append(0, np.cumsum(_LETTER[b.buf]))
        lettered = total[b.end] > total[b.begin]
        for i in np.flatnonzero(~lettered):
            lettered[i] = any(c.isalpha() for c in b.data[b.begin[i] : b.end[i]].decode(errors="replace"))
        return [self.languages[j] if ok else "und" for j, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, p[np.arange(b.n), best], 0.0)


def train(texts: list[str], languages: list[str], seed: int = 10) -> Model:
    names = sorted(set(languages))
    k = len(names)
    if k < 2:
        return Model(names, np.ones(1 << BITS), np.zeros((1 << BITS, k)), np.zeros(k), 1.0)
    y = np.array([names.index(x) for x in languages])
    rows, buckets, counts = sparse_counts(texts, LENGTHS, BITS, words=False, table=LOWER)
    df = np.bincount(buckets, minlength=1 << BITS)
    idf = np.log((1 + len(y)) / (1 + df)) + 0.1
    feats = []
    for d in range(len(y)):
        at = buckets[rows[d] : rows[d + 1]]
        x = counts[rows[d] : rows[d + 1]] * idf[at]
        feats.append((at, SCALE * x / max(x.sum(), 1e-12)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, seen = order[: len(y) // 5], order[len(y) // 5 :]
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias, bias_n = np.zeros(k), np.ones(k)

    def solve(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for d in rng.permutation(seen):
            at, x = feats[d]
            w = solve(at)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[d]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += p * p
            bias -= 0.1 * p / np.sqrt(bias_n)
    weights = solve(slice(None))
    temperature = 1.0
    if len(held):
        scores = np.stack([x @ weights[at] + bias for at, x in (feats[d] for d in held)])

        def loss(t):
            s = scores / t
            top = s.max(1)
            return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(held)), y[held]]))

        temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return Model(names, idf, weights, bias, float(temperature))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model from documents with a language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    # a language's rows of least hash: first those under a rate that leaves a few times what is needed
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30))
    near = F.lit(False)
    for lang, n in sizes.items():
        near = near | ((F.col("lang") == lang) & (draw <= int((1 << 30) * min(1.0, 3 * rows / n))))
    few = known.where(near).select("doc_id", "lang", draw.alias("d")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("d", "doc_id"))).where(F.col("rank") <= rows).select("doc_id", "lang")
    got = sample(known.select("doc_id", "text", "lang").join(F.broadcast(few.distinct()), ["doc_id", "lang"]), rows * len(sizes), max_bytes)
    return train([r.text for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``lang_pred`` and ``score``."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def make():
        def work(rows):
            names = rows.schema.names
            langs, scores = shared.value.predict(rows.column(names.index("text")))
            return {c: rows.column(names.index(c)) for c in keep} | {"lang_pred": langs, "score": scores}

        return work

    return map_batches(source, source.columns, with_fields(source, keep, "lang_pred string, score double"), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
