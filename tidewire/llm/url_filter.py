"""URL filters: rules first, then gradient-boosted trees on lexical features, trained from labelled URLs.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest fitting rule
gives the verdict. URLs that a rule fits are the labelled ones; trees trained on at most ``TRAIN_ROWS`` of them (those
of least hash) judge the others by length, depth, digit ratio, entropy, parameters and suffix statistics. The statistics of
a learned URL are those of other folds of hosts, so a suffix says no more than it does of hosts that were not seen.

Cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the trees on those
empty parts; an empty table gives no rows; without labelled URLs, or with labels of one kind, the trees are a
constant (allow without any); repeated rows are judged alike; only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .kernel import LOWER, map_batches, table

#: Rule, verdict.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
TRAIN_ROWS = 5000
#: Folds of hosts, and how many urls a suffix statistic needs to count for half.
FOLDS, STRENGTH = 5, 10.0
NAMES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "secure", "suffix", "suffix2"]
_LOWER = {i: chr(b) for i, b in enumerate(LOWER) if i < 128}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"[^/?#]*", rest)
    return m.group().translate(_LOWER), re.match(r"[^?#]*", rest[m.end() :]).group()


class Rules:
    """Rules by host; a host's candidates are its suffixes, so the cost is its number of labels, whatever the rules."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def fit(self, host: str, path: str) -> tuple[str, str] | None:
        labels, best = host.split("."), None
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str | None, suffixes: dict[str, float]) -> list[float]:
    url = url or ""
    host, path = split_url(url)
    counts = Counter(url)
    n = max(len(url), 1)
    query = url.partition("?")[2].partition("#")[0]
    last, two = _suffixes(host)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / n, entropy, query.count("=") + query.count("&"), host.count("-"), "#" in url, url[:6] == "https:", suffixes.get(last, 0.0), suffixes.get(two, 0.0)]


def _statistics(suffixes: list[tuple[str, str]], labels: np.ndarray) -> dict[str, float]:
    """By suffix, log odds of block beyond the whole's, drawn to 0 as if ``STRENGTH`` urls of the whole had been seen too."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    good, bad = Counter(), Counter()
    for two, y in zip(suffixes, labels.tolist(), strict=True):
        (bad if y else good).update(set(two))
    return {s: float(np.log((bad[s] + STRENGTH * share) / (good[s] + STRENGTH * (1 - share)) * (1 - share) / share)) for s in good.keys() | bad.keys()}


class Judge:
    """Trees and suffix statistics. Urls are learned from with statistics of other hosts only, as unknown ones will be judged.

    ``held_out``: accuracy on the last fold of hosts by trees that have not seen it, and the larger label's share there.
    """

    def __init__(self, urls: list[str | None], labels: list[int]):
        y = np.array(labels, int)
        hosts = [split_url(u)[0] for u in urls]
        pairs = [_suffixes(h) for h in hosts]
        fold = np.array([crc32(h.encode()) % FOLDS for h in hosts], int)
        x = np.zeros((len(urls), len(NAMES)))
        for f in range(FOLDS):
            others = _statistics([p for p, k in zip(pairs, fold, strict=True) if k != f], y[fold != f])
            for i in np.flatnonzero(fold == f).tolist():
                x[i] = lexical(urls[i], others)
        self.suffixes = _statistics(pairs, y)
        self.trees = boosting.fit(x, y, NAMES)
        self.known = bool(labels)
        last = fold == FOLDS - 1
        self.held_out = (float("nan"), float("nan"))
        if last.any() and not last.all():
            right = (boosting.fit(x[~last], y[~last], NAMES).probability(x[last]) >= 0.5) == y[last]
            self.held_out = float(right.mean()), float(max(y[last].mean(), 1 - y[last].mean()))

    def block(self, urls: list[str | None]) -> np.ndarray:
        """Probability that a url is to be blocked."""
        x = np.array([lexical(u, self.suffixes) for u in urls], float).reshape(-1, len(NAMES))
        return self.trees.probability(x) if self.known else np.zeros(len(urls))


def fit(pages: DataFrame, rules: list[tuple[str, str]] = RULES, rows: int = TRAIN_ROWS) -> Judge:
    ruled = _ruled(pages, rules).where("rule is not null")
    # rows under a rate that leaves about twice what is needed, so that tasks don't send their own best to one place
    draw = F.xxhash64("page_id", "url")
    rate = int((1 << 30) * min(1.0, 2 * rows / max(ruled.count(), 1)))
    ruled = ruled.where(F.pmod(draw, F.lit(1 << 30)) <= rate).orderBy(F.pmod(draw, F.lit(1 << 30)), "page_id").limit(rows).collect()
    return Judge([r.url for r in ruled], [int(r.verdict == "block") for r in ruled])


def _ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    def make():
        known = Rules(rules)

        def work(batch):
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [known.fit(h, p) or (None, None) for h, p in parts]
            return {"page_id": batch.column(0), "url": urls, "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r for r, _ in found], "verdict": [v for _, v in found]}

        return work

    return map_batches(pages, ["page_id", "url"], "page_id bigint, url string, host string, path string, rule string, verdict string", make)


def judge(pages: DataFrame, model: Judge, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of block where no rule fits."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            names = batch.schema.names
            p = shared.value.block(batch.column(names.index("url")).to_pylist())
            verdict = [v or ("block" if x >= 0.5 else "allow") for v, x in zip(batch.column(names.index("verdict")).to_pylist(), p.tolist(), strict=True)]
            return {c: batch.column(names.index(c)) for c in ("page_id", "host", "path", "rule")} | {"verdict": verdict, "block_probability": p}

        return work

    ruled = _ruled(pages, rules)
    return map_batches(ruled, ruled.columns, "page_id bigint, host string, path string, rule string, verdict string, block_probability double", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages))
