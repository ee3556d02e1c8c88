"""Quality rules with risk-controlled thresholds.

Every document gets the figures of ``METRICS`` from its whole text, and fails a rule if a figure lies beyond the rule's
cutoff. Cutoffs are chosen by stratum on labelled documents that pass the base rules, in two steps on two separate folds:

1. The choosing fold (a quarter) gives an order: from no cutoff at all, the rule and stricter cutoff that rejects most bad
   documents for each good one comes next, and so on. Each step's cutoffs reject all that the step before rejects.
2. The holdout (the rest) tests the steps in that order. A step is admitted if the exact (Clopper-Pearson) upper bound of the
   share of good documents that its rules reject, all together, is at most ``RISK``; the first that isn't ends the
   sequence. Tests in a fixed order need no correction among themselves; among strata, the confidence is
   ``1 - DELTA / strata`` each (Bonferroni). So with confidence ``1 - DELTA`` no stratum loses more than ``RISK`` of its good ones.

A stratum with too few good labels for any step is tested together with the others of that kind, as one more stratum.

Cases: a null or empty text has no words and fails the base rules; a label on a repeated id counts once
and the worse one counts; an unlabelled stratum has no cutoffs; an empty label table, or one too small for the bound, keeps all
documents that pass the base rules; ties between steps go to the rule listed first; columns beyond ``doc_id``, ``text``
and the stratum are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import beta_inc
from .kernel import Batch, map_batches, mix, shared, table, utf8, with_fields

RISK = 0.01
DELTA = 0.05
#: One label in so many chooses the order of the steps.
CHOOSING = 4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: name: (figure, cutoffs from the strictest on); a document fails if its figure lies above the cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0]),
    "dup_lines": ("n_dup_lines / n_lines", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "repeats": ("n_repeat_words / n_words", [0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18]),
    "long_words": ("word_chars / n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_words": ("-word_chars / n_words", [-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0]),
    "few_words": ("-n_words", [-200.0, -150.0, -100.0, -75.0, -50.0, -40.0, -30.0, -20.0, -15.0]),
}
METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
_SALT = np.uint64(0x9FB21C651E98DF25)


def _by_doc(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[begin]


def figures(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    b = Batch(raw, off)
    words = b.word_off[:-1], b.word_off[1:]
    word_chars = _by_doc(((b.buf & 0xC0) != 0x80) & ~np.isin(b.buf, np.array([32, 9, 10, 11, 12, 13], np.uint8)), b.begin, b.end)
    breaks = np.flatnonzero(b.buf == 10)
    starts = np.append(0, breaks[:-1] + 1)
    filled = np.searchsorted(b.starts, starts) < np.searchsorted(b.starts, breaks)
    starts, ends = starts[filled], breaks[filled]
    doc = np.searchsorted(b.begin, starts, "right") - 1
    _, first = np.unique(mix(b.span_hashes(starts, ends) + doc.astype(np.uint64) * _SALT), return_index=True)
    n_lines = np.bincount(doc, minlength=b.n)
    at, h = b.windows(5)
    key = mix(h + b.doc_of_word()[at].astype(np.uint64) * _SALT)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(b.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    return {"n_words": b.counts, "word_chars": word_chars, "n_symbols": _by_doc(SYMBOLS[b.buf], b.begin, b.end), "n_lines": n_lines, "n_dup_lines": n_lines - np.bincount(doc[first], minlength=b.n), "n_repeat_words": _by_doc(np.cumsum(cover[:-1]) > 0, *words)}


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the figures of each text."""
    docs = docs.select(*keep, F.col(text_col).alias("text"))

    def make():
        def work(rows):
            got = figures(*utf8(rows.column(rows.schema.names.index("text"))))
            return got | {c: rows.column(rows.schema.names.index(c)) for c in keep}

        return work

    return map_batches(docs, docs.columns, with_fields(docs, keep, METRICS), make)


def upper_bound(failed: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a share, from ``failed`` of ``n``."""
    if n == 0 or failed >= n:
        return 1.0
    low, high = failed / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if beta_inc(n - failed, failed + 1, 1 - p) > delta else (low, p)
    return high


def admitted(failed: int, n: int, risk: float, delta: float) -> bool:
    """Whether the upper bound is at most ``risk``: so few failures would be rarer than ``delta`` at any larger share."""
    return failed < n * risk and beta_inc(n - failed, failed + 1, 1 - risk) <= delta


def _figure(rule: str):
    return F.expr(RULES[rule][0].replace("/ n_words", "/ greatest(n_words, 1)").replace("/ n_lines", "/ greatest(n_lines, 1)"))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Counts of documents by how many cutoffs of each rule they exceed.
Counts = dict[tuple[int, ...], int]


def _rejected(counts: Counts, config: list[int]) -> int:
    return sum(n for exceeded, n in counts.items() if any(e > c for e, c in zip(exceeded, config, strict=True)))


def steps(good: Counts, bad: Counts) -> list[list[int]]:
    """Configurations, each stricter than the one before: by rule, the number of the cutoff in force, or that of all cutoffs for none."""
    config = [len(cuts) for _, cuts in RULES.values()]
    out = []
    lost, caught = 0, 0
    while True:
        best = None
        for r, now in enumerate(config):
            for c in range(now):
                new = config[:r] + [c] + config[r + 1 :]
                more = _rejected(bad, new) - caught
                if more > 0 and (best is None or more * (best[1] + 1) > best[0] * (_rejected(good, new) - lost + 1)):
                    best = more, _rejected(good, new) - lost, new
        if best is None:
            return out
        config, lost, caught = best[2], lost + best[1], caught + best[0]
        out.append(config)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule). ``measured`` holds the figures of all documents, ``labels`` doc_id and quality.

    What is gathered is a count for each combination of grid places that occurs, not of documents.
    """
    worst = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    exceeded = [sum((_figure(r) > c).cast("int") for c in cuts).alias(r) for r, (_, cuts) in RULES.items()]
    graded = measured.where(~base_failed()).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("s"), *exceeded).join(worst, "doc_id")
    chosen = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(CHOOSING)) == 0
    counts: dict[tuple[str, bool, bool], Counts] = defaultdict(lambda: defaultdict(int))
    for row in graded.groupBy("s", chosen.alias("chosen"), "good", *RULES).count().collect():
        counts[row.s, row.chosen, row.good][tuple(row[r] for r in RULES)] += row["count"]
    strata = sorted({s for s, _, _ in counts})
    if not strata:
        return {}
    level = delta / (len(strata) + 1)
    needed = math.log(level) / math.log1p(-risk)
    held = {s: sum(counts[s, False, True].values()) for s in strata}
    apart = [[s] for s in strata if held[s] >= needed]
    pooled = [s for s in strata if held[s] < needed]
    out = {}
    for group in [*apart, pooled] if pooled else apart:

        def of(chosen: bool, good: bool, group=group) -> Counts:
            both: Counts = defaultdict(int)
            for s in group:
                for k, n in counts[s, chosen, good].items():
                    both[k] += n
            return both

        good = of(False, True)
        n, last = sum(good.values()), None
        for config in steps(of(True, True), of(True, False)):
            if not admitted(_rejected(good, config), n, risk, level):
                break
            last = config
        if last:
            out |= {(s, r): cuts[c] for s in group for (r, (_, cuts)), c in zip(RULES.items(), last, strict=True) if c < len(cuts)}
    return out


def verdicts(measured: DataFrame, cutoffs: dict[tuple[str, str], float], stratum: str = "lang") -> DataFrame:
    """Adds base_failed, kept and the rule that a rejected document fails first."""
    base = base_failed()
    fails = [F.when((F.coalesce(F.col(stratum), F.lit("")) == s) & (_figure(r) > c), F.lit(r)) for (s, r), c in sorted(cutoffs.items())]
    return measured.withColumn("base_failed", base).withColumn("failed_rule", F.when(base, F.lit("base")).otherwise(F.coalesce(*fails) if fails else F.lit(None).cast("string"))).withColumn("kept", F.col("failed_rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = shared(measure(table(spark, sf_dir, "documents"), ["doc_id", "lang"]))
    cutoffs = thresholds(measured, table(spark, sf_dir, "labels"))
    return verdicts(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")
