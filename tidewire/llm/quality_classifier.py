"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, of its pairs of neighbouring words and of the character n-grams
of its words, all hashed; a linear layer and a softmax follow. Vectors and layer are trained together by stochastic
gradient descent in numpy. Two classes make the output a logistic of one number, so for scoring the
vectors are multiplied by the layer once, and a document's score is the average of one number a feature.

The fit uses at most ``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` of their texts, outside the
held-out fold; texts are taken whole. Scoring covers every row and whole texts.

Cases: null and empty texts score by the layer's bias; a repeated label counts once (the worse one);
without labels of both kinds every score is the share of good labels, or 0.5 without any; repeated
rows are scored alike; columns beyond ``doc_id`` and ``text`` are not read by the fit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import Vocabulary, sparse_counts
from .kernel import fold, map_batches, packed, table, unpacked, utf8, with_fields

TRAIN_ROWS = 3000
TRAIN_BYTES = 16 << 20
BITS, DIM, LENGTHS = 16, 8, (3, 4)
EPOCHS, RATE, DECAY = 8, 0.5, 1e-6
#: Few rows are gone over more often, until this many have been seen.
TRAIN_STEPS = 24_000
THRESHOLD = 0.3


class Model:
    """``table``: the contribution of each bucket to the log odds of quality; ``bias``: their offset."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.table, self.bias = weights, bias

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        v = Vocabulary(raw, off)
        w, g = v.grams(LENGTHS, BITS)
        value = np.bincount(w, weights=self.table[g], minlength=v.size) + self.table[v.word_buckets(BITS) + (1 << BITS)]
        number = np.bincount(w, minlength=v.size) + 1.0
        both = v.document_sums(np.stack([value, number], 1)) if v.size else np.zeros((v.batch.n, 2))
        doc, pair = v.pairs(BITS)
        both += np.stack([np.bincount(doc, weights=self.table[pair + (2 << BITS)], minlength=v.batch.n), np.bincount(doc, minlength=v.batch.n)], 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + both[:, 0] / np.maximum(both[:, 1], 1), -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(3 << BITS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    rows, buckets, counts = sparse_counts(texts, LENGTHS, BITS, words=True)
    embed = rng.uniform(-1, 1, (3 << BITS, DIM)) / DIM
    layer, bias = rng.uniform(-1, 1, (DIM, 2)) / DIM, np.log(np.bincount(y, minlength=2) / len(y))
    averaged = [embed * 0, layer * 0, bias * 0]
    steps, kept = 0, 0
    epochs = max(EPOCHS, min(8 * EPOCHS, TRAIN_STEPS // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 8):
            docs = order[lo : lo + 8]
            rate = RATE * (1 - steps / (epochs * (len(y) // 8 + 1)))
            steps += 1
            parts = [(buckets[rows[d] : rows[d + 1]], counts[rows[d] : rows[d + 1]]) for d in docs]
            h = np.stack([(c / max(c.sum(), 1)) @ embed[b] for b, c in parts])
            z = h @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            back = p @ layer.T
            layer -= rate * (h.T @ p / len(docs) + DECAY * layer)
            bias -= rate * p.mean(0)
            for (b, c), g in zip(parts, back, strict=True):
                embed[b] -= (rate * 4 * c / max(c.sum(), 1))[:, None] * g
        if epoch >= epochs // 2:
            kept += 1
            for a, x in zip(averaged, (embed, layer, bias), strict=True):
                a += x
    embed, layer, bias = (a / kept for a in averaged)
    return Model(embed @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labelled documents outside the held-out fold."""
    from .features import sample

    worst = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(fold("doc_id", 5) != 0)
    # labels under a rate that leaves about twice what is needed, so that tasks don't send their own best to one place
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    rate = int((1 << 30) * min(1.0, 2 * rows / max(worst.count(), 1)))
    few = worst.where(draw <= rate).orderBy(draw, "doc_id").limit(rows)
    got = sample(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id"), rows, max_bytes)
    return train([r.text for r in got], [int(r.quality > 0) for r in got])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``."""
    keep = [c for c in keep if c != "score"]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def make():
        def work(rows):
            names = rows.schema.names
            return {c: rows.column(names.index(c)) for c in keep} | {"score": shared.value.score(*utf8(rows.column(names.index("text"))))}

        return work

    return map_batches(source, source.columns, with_fields(source, keep, "score double"), make)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return unpacked(score(packed(docs, "text"), fit(docs, labels), ["_row"]).where(F.col("score") >= threshold), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
