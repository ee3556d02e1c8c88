"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base patterns give email, ip, card and phone spans. On top, generators of high recall propose looser, overlapping
spans of the same kinds. Each proposal gets format and context features; boosted trees score it, and those that reach
their kind's calibrated threshold are added where they overlap no base span and no earlier added one of their kind.

The trees learn from proposals whose place tells what they are, by features that all proposals have. Base matches that pass
their checks (part sizes, check digit) stand against those that fail. A loose phone number is one where a country's code
stands before it, and none where it is a part of a dotted address; neither is a feature. Every base email is a span, so emails
are told apart by how plausible they are: a usual suffix, and dots, hyphens and lengths as addresses have them. The
learning rows of all documents are counted by feature vector in the cluster. The driver gathers at most ``GRID_ROWS`` counts for the
trees, and counts by score (which has few values) for the thresholds, but no text. A kind's threshold is the least one whose
precision on the held-out half, by a lower confidence bound, is at least ``PRECISION``; a kind without such evidence adds nothing.

Positions: the pieces between matches (``split``) and the matches (``regexp_extract_all``) alternate, so starts are running
sums of their lengths, taken by blocks, in code points. The text around a match is taken from its two pieces, and overlaps
are found by running counts over all sorted ends, so that a text full of matches costs little more than its length.

Cases: null and empty texts have no spans; rows are independent, so repeated ids and rows stay; an empty table
gives no rows and a constant model; very long texts are scanned whole (the patterns don't backtrack); other columns
are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .kernel import shared, table

KINDS = ("email", "ip", "card", "phone")
GRID_ROWS = 20_000
PRECISION = 0.9

#: Base patterns. Each gives the same matches as the plain form: possessive where nothing can be given back, and begun
#: only where the plain form would begin (not inside a run, or right after a match), so that no run is scanned twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}[\x20./_-]?[0-9]{4,6}[\x20./_-]?[0-9]{4,5}[\x20./_-]?[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A text without this has no match of the kind, base or loose.
GUARD = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9](?:\.|\[\.\])[0-9]", "card": r"[0-9](?:[\x20./_-]?[0-9]){11}", "phone": r"\+[0-9]|[0-9]\)?[\x20./-][0-9]{3}"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
OCTETS = rf"^{_OCTET}(?:(?:\.|\[\.\]){_OCTET}){{3}}$"
FEATURES = ["digits", "size", "marks", "dots", "hyphens", "luhn", "octets", "tight_left", "tight_right", "keyword", "groups", "suffix", "flaws"]
_BLOCK = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL: whether 13 to 19 digits pass the check."""
    value = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {value} WHEN {value} > 4 THEN 2 * {value} - 9 ELSE 2 * {value} END) % 10 = 0)"


def _running(df: DataFrame, name: str, values: str) -> DataFrame:
    """Adds ``name``: the running sums of an array column of numbers, or null for null.

    Sums are taken within blocks, and over the blocks' totals: a slice costs as much as the array that it is of. A column
    that a lambda reads is tested for null outside of it too, or the optimiser would move its expression inside.
    """
    total = lambda x: f"aggregate({x}, 0, (a, x) -> a + x)"
    df = df.withColumn("_b", F.expr(f"CASE WHEN {values} IS NOT NULL THEN transform(sequence(0, size({values}) div {_BLOCK}), b -> slice({values}, CAST(b * {_BLOCK} + 1 AS INT), {_BLOCK})) END"))
    df = df.withColumn("_t", F.expr(f"transform(_b, x -> {total('x')})"))
    df = df.withColumn("_o", F.expr(f"transform(_t, (x, i) -> {total('slice(_t, 1, i)')})"))
    return df.withColumn(name, F.expr(f"CASE WHEN _o IS NOT NULL THEN flatten(transform(_b, (block, i) -> transform(block, (x, j) -> _o[i] + {total('slice(block, 1, j + 1)')}))) END")).drop("_b", "_t", "_o")


def _located(df: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """Adds ``name``: the matches of ``pattern`` in ``text`` with their places and what stands around them, as array<struct<s, e, t, l, r>>."""
    q, g = _quoted(pattern), f"text rlike {_quoted(guard)}"
    df = df.withColumn("_m", F.expr(f"CASE WHEN {g} THEN regexp_extract_all(text, {q}, 0) END"))
    df = df.withColumn("_p", F.expr(f"CASE WHEN size(_m) > 0 THEN split(text, {q}, -1) END"))
    df = df.withColumn("_l", F.expr("CASE WHEN _p IS NOT NULL THEN transform(_m, (x, i) -> length(_p[i]) + CASE WHEN i = 0 THEN 0 ELSE length(_m[i - 1]) END) END"))
    df = _running(df, "_s", "_l")
    # a match at the end of another has nothing before it: the other's end stands there
    left = "CASE WHEN _p[i] = '' AND i > 0 THEN right(_m[i - 1], 1) ELSE right(_p[i], 24) END"
    right = "CASE WHEN _p[i + 1] = '' AND i + 1 < size(_m) THEN left(_m[i + 1], 4) ELSE left(_p[i + 1], 4) END"
    df = df.withColumn(name, F.expr(f"CASE WHEN _s IS NOT NULL THEN transform(_m, (x, i) -> named_struct('s', _s[i], 'e', _s[i] + length(x), 't', x, 'l', {left}, 'r', {right})) END"))
    return df.drop("_m", "_p", "_l", "_s")


_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": f"x.t rlike {_quoted(OCTETS)}",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
#: A match without the disguise of its kind.
_BARE = {k: "x.t" for k in KINDS} | {"email": f"regexp_replace(regexp_replace(x.t, {_quoted(r'\x20?[(\[{]at[)\]}]\x20?')}, '@'), {_quoted(r'\x20?[(\[]dot[)\]]\x20?')}, '.')"}
_USUAL = r"\.(?:(?i:com|org|net|edu|gov|mil|int|info|biz|name|app|dev|online|site|shop|xyz|cloud)|[a-z]{2})$"
_FLAWED = r"^\.|\.@|\.\.|^[^@]{65}|@(?:[^@]*\.)?-|@[^@]*-(?:\.|$)|@(?:[^@]*\.)?[^.@]{64}"
#: 2 for a usual suffix, 1 for other letters; none where bare marks stand apart, as in "see you @ home. It was".
_SUFFIX = {k: "0" for k in KINDS} | {"email": f"CASE WHEN {_BARE['email']} rlike '[ ]' THEN 0 WHEN {_BARE['email']} rlike {_quoted(_USUAL)} THEN 2 WHEN {_BARE['email']} rlike {_quoted(r'\.[A-Za-z]{2,24}$')} THEN 1 ELSE 0 END"}
_FLAWS = {k: "0" for k in KINDS} | {"email": f"CAST({_BARE['email']} rlike {_quoted(_FLAWED)} AS INT)"}
#: What the trees learn to tell, of base matches and of loose ones; null where nothing tells.
LABELS = CHECKS | {"email": f"({_SUFFIX['email']} = 2 AND {_FLAWS['email']} = 0)"}
_QUAD = r"(?:[0-9]{1,3}\.){3}[0-9]"
LOOSE_LABELS = {k: "CAST(NULL AS BOOLEAN)" for k in KINDS} | {"phone": f"CASE WHEN x.l rlike {_quoted(r'\+[0-9]{1,3}[\x20.(-]*$')} THEN true WHEN concat(x.t, x.r) rlike {_quoted('^' + _QUAD)} OR concat(right(x.l, 4), x.t) rlike {_quoted(r'\.' + _QUAD[:-5].replace('{3}', '{2}') + '[0-9]')} THEN false END"}
_KEYWORD = {"email": "e?mail|contact|write|adress", "ip": "ip|addr|host|server|login", "card": "card|visa|credit|payment|pay", "phone": "phone|tel|call|mobile|fax|sms"}


def _featured(kind: str, labels: dict[str, str]) -> str:
    """SQL: a located match x with its features."""
    return f"""named_struct('s', x.s, 'e', x.e, 'ok', {CHECKS[kind]}, 'good', {labels[kind]},
 'digits', least(length({_DIGITS}), 24), 'size', least(length({_BARE[kind]}), 48), 'marks', least(length(regexp_replace({_BARE[kind]}, '[A-Za-z0-9]', '')), 10),
 'dots', least(length(regexp_replace(x.t, '[^.]', '')), 6), 'hyphens', least(length(regexp_replace(x.t, '[^-]', '')), 6),
 'luhn', CAST({_luhn(_DIGITS)} AS INT), 'octets', CAST(x.t rlike {_quoted(OCTETS)} AS INT),
 'tight_left', CAST(x.l rlike '[A-Za-z0-9]$' AS INT), 'tight_right', CAST(x.r rlike '^[A-Za-z0-9]' AS INT),
 'keyword', CAST(lower(x.l) rlike '{_KEYWORD[kind]}' AS INT), 'groups', least(size(split(x.t, '[^0-9]+')), 8), 'suffix', {_SUFFIX[kind]}, 'flaws', {_FLAWS[kind]})"""


def proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds, by kind, ``base_<kind>`` (base matches with features and check) and ``loose_<kind>``."""
    df = docs.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    # most texts have neither digit nor at-sign: they pay for one look only
    df = df.withColumn("_some", F.expr("CASE WHEN text rlike '[0-9@]|[(\\\\[{]at[)\\\\]}]' THEN text END"))
    df = df.withColumnRenamed("text", "_whole").withColumnRenamed("_some", "text")
    for kind in KINDS:
        for name, pattern, labels in ((f"base_{kind}", BASE[kind], LABELS), (f"loose_{kind}", LOOSE[kind], LOOSE_LABELS)):
            df = _located(df, name, pattern, GUARD[kind])
            df = df.withColumn(name, F.expr(f"coalesce(transform({name}, x -> {_featured(kind, labels)}), array())"))
    return df.drop("text").withColumnRenamed("_whole", "text")


class Model:
    def __init__(self, trees: dict[str, boosting.Trees], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds by kind, from the counted feature vectors of the telling matches of all documents.

    The trees learn from at most ``GRID_ROWS`` vectors of one half of the documents, the most frequent of each kind and
    label; thresholds take all vectors of the other half, summed by score in the cluster.
    """
    some = proposals(docs.select("doc_id", "text"))
    seen = some.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold"), F.explode(F.concat(*[F.expr(f"transform({x}_{k}, x -> struct('{k}' AS kind, x))") for k in KINDS for x in (("base",) if k != "phone" else ("base", "loose"))])).alias("c")).where("c.x.good IS NOT NULL")
    counts = shared(seen.groupBy("fold", "c.kind", "c.x.good", *[F.col(f"c.x.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n")))
    share = GRID_ROWS // (2 * len(KINDS))
    parts = [counts.where((F.col("fold") == 0) & (F.col("kind") == k) & (F.col("good") == y)).orderBy(F.desc("n"), *FEATURES).limit(share) for k in KINDS for y in (True, False)]
    grid = reduce(DataFrame.union, parts).collect()
    trees = {}
    for kind in KINDS:
        rows = [r for r in grid if r.kind == kind]
        x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
        y, n = (np.array([r[c] for r in rows], float) for c in ("good", "n"))
        trees[kind] = boosting.fit(x, y, FEATURES, n, rounds=12, depth=3)
    score = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {trees[k].sql()}" for k in KINDS) + " END")
    held = counts.where("fold = 1").groupBy("kind", score.alias("z")).agg(F.sum("n").alias("n"), F.sum(F.expr("CASE WHEN good THEN n ELSE 0 END")).alias("hits")).collect()
    return Model(trees, {k: _threshold([(r.z, r.n, r.hits) for r in held if r.kind == k]) if trees[k].trees else float("inf") for k in KINDS})


def _threshold(scores: list[tuple[float, int, int]]) -> float:
    """The least score from which on precision holds, from (score, rows, good rows); infinite without rows that fail."""
    if not any(hits < n for _, n, hits in scores):
        return float("inf")
    z, n, hits = np.array(sorted(scores, reverse=True), float).T
    all_ = np.cumsum(n)
    share = np.cumsum(hits) / all_
    # Wilson's lower bound at two standard errors
    low = (share + 2 / all_ - 2 * np.sqrt(share * (1 - share) / all_ + 1 / all_**2)) / (1 + 4 / all_)
    good = np.flatnonzero(low >= PRECISION)
    return float(z[good[-1]]) if len(good) else float("inf")


def redactions(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans``, sorted array<struct<s, k, e>> with k the number of the kind, and drops the proposals."""
    df = proposals(docs)
    chosen = []
    for k, kind in enumerate(KINDS):
        df = df.withColumn(f"base_{kind}", F.expr(f"transform(filter(base_{kind}, x -> x.ok), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"))
        if model.thresholds[kind] < float("inf"):
            score = model.trees[kind].sql("x.{}")
            df = df.withColumn(f"loose_{kind}", F.expr(f"transform(filter(loose_{kind}, x -> {score} >= {model.thresholds[kind]!r}D), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"))
            chosen.append(f"loose_{kind}")
    df = df.withColumn("base_spans", F.array_sort(F.concat(*[f"base_{k}" for k in KINDS])))
    if not chosen:
        return df.withColumn("all_spans", F.col("base_spans"))
    df = df.withColumn("_c", F.expr(f"CASE WHEN size(concat({', '.join(chosen)})) > 0 THEN concat({', '.join(chosen)}) END"))
    return _free(df, "_c", "base_spans", "_f").withColumn("all_spans", F.expr("CASE WHEN size(_f) > 0 THEN array_sort(concat(base_spans, _f)) ELSE base_spans END")).drop("_c", "_f")


def _free(df: DataFrame, spans: str, others: str, name: str) -> DataFrame:
    """Adds ``name``: the ``spans`` that overlap none of ``others``.

    All ends are sorted together. Where a span starts, the others begun less those ended must be none, and up to its
    end no other may start.
    """
    df = df.withColumn("_e", F.expr(f"""CASE WHEN {spans} IS NOT NULL THEN array_sort(concat(
 transform({others}, x -> named_struct('p', x.s, 'o', 1, 'i', -1, 'd', 1, 'n', 1)), transform({others}, x -> named_struct('p', x.e, 'o', 0, 'i', -1, 'd', -1, 'n', 0)),
 transform({spans}, (x, i) -> named_struct('p', x.s, 'o', 2, 'i', i, 'd', 0, 'n', 0)), transform({spans}, (x, i) -> named_struct('p', x.e, 'o', 0, 'i', i, 'd', 0, 'n', 0)))) END"""))
    df = df.withColumn("_d", F.expr("transform(_e, x -> x.d)")).withColumn("_n", F.expr("transform(_e, x -> x.n)"))
    df = _running(_running(df, "_open", "_d"), "_begun", "_n")
    # by span: its end, then its start
    df = df.withColumn("_q", F.expr("CASE WHEN _open IS NOT NULL AND _begun IS NOT NULL THEN array_sort(filter(transform(_e, (x, j) -> named_struct('i', x.i, 'o', x.o, 'open', _open[j], 'begun', _begun[j])), x -> x.i >= 0)) END"))
    return df.withColumn(name, F.expr(f"filter({spans}, (x, i) -> _q[2 * i + 1].open = 0 AND _q[2 * i].begun = _q[2 * i + 1].begun)")).drop("_e", "_d", "_n", "_open", "_begun", "_q")


def _text(spans: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with each span's characters replaced by asterisks, in their own columns."""
    df = redactions(docs, model)
    masked = "aggregate(all_spans, text, (t, x) -> concat(substr(t, 1, x.s), repeat('*', x.e - x.s), substr(t, x.e + 1)))"
    return df.withColumn("text", F.expr(masked)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redactions(docs, fit(docs))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text("base_spans").cast("binary"), 256).alias("base_sha256"), _text("all_spans").alias("spans"))
