"""Text functions as columns; only entity decoding falls back to an Arrow function, and only where needed."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Replacements in their order (an earlier one may take a part of a later one).
REPLACEMENTS = [
    ("Â", ""), ("â€•", "-"), ("â€‹", ""), ("â€Œ", ""), ("â€\x8d", ""), ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""),
    ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."),
    ("â\x80\x98", "'"), ("â\x80\x99", "'"), ("â\x80\x9c", '"'), ("â\x80\x9d", '"'), ("â\x80\x93", "-"), ("â\x80\x94", "-"), ("â\x80\xa6", "..."),
    ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€\x98", "'"), ("â€\x99", "'"), ("â€\x9c", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."),
    ("Ã¢â‚¬â„¢", "'"), ("Ã¢â‚¬Ëœ", "'"), ("Ã¢â‚¬Å“", '"'), ("Ã¢â‚¬\x9d", '"'), ("Ã¢â‚¬â€œ", "-"), ("Ã¢â‚¬Â¦", "..."), ("Ã‚ ", " "), ("\xa0", " "),
]
# Replacements before texts are matched.
MATCH_REPLACEMENTS = [("\x91", "'"), ("\x92", "'"), ("\x93", '"'), ("\x94", '"'), ("\x96", "-"), ("\x97", "-"), ("\xa0", " "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")]
# What mojibake looks like.
MARKERS = ("Ã", "Â", "â‚¬", "â€œ", "â€", "â€™", "â€¦")
# The characters that cp1252 has in place of latin-1's U+0080-9F, and these.
CP1252 = "".join(bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_BYTES = CP1252.encode("cp1252").decode("latin-1")
# Query keys that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
# Boilerplate inside a text, removed in this order, in any case.
BOILERPLATE = (
    r"stay current\s*-\s*follow fmt[^.]*\.?",
    r"follow us on[^.]*\.?",
    r"subscribe to our newsletter[^.]*\.?",
    r"registration on or use of this site[^.]*\.?",
    r"terms of service[^.]*\.?",
    r"privacy policy[^.]*\.?",
    r"cookies policy[^.]*\.?",
    r"copyright\s*[^\n.]*\.?",
    r"all rights reserved\.?",
    r"\bread also\b[^.]*\.?",
    r"\brelated\b[^.]*\.?",
)
# Datelines at the head of a text, the first that matches counts. A place goes on over a line end or a tab at most
# five times; blanks inside it belong to its letters, so that each end of it can be reached in one way only.
_PLACE = r"^\s*+[A-Z][A-Z .,&'/-]{2,}(?:[\t\n\x0B\f\r]\s*+[A-Z][A-Z .,&'/-]{2,}){0,5}"
DATELINES = (
    _PLACE + r"\s*:\s+",
    _PLACE + r"\s*\(\s*\d{1,2}\s+[A-Z]{3,12}\s*\)\s*:\s+",
    _PLACE + r"\s*\(\s*[A-Za-z]{3,12}\s+\d{1,2}(?:,\s*\d{4})?\s*\)\s*:\s+",
    "(?i)" + _PLACE + r"(?:,\s*[A-Za-z]{3,12}\s+\d{1,2})?\s*\(Reuters\)\s*[-:]\s+",
    _PLACE + r"\s*,\s*[A-Za-z]{3,12}\s+\d{1,2}(?:,\s*\d{4})?\s*[—-]\s+",
)
NAVIGATION = r"(?i)^\s*(?:about us|advertise|contact us|sign up|log in|home)(?:\s*[|:/-]\s*|\s+){1,8}"
HEAD = 180


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """Runs of white space (Unicode's, and the separators U+001C-1F) to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def mojibake_score(c: str | Column) -> Column:
    """P5: occurrences of the markers, each marker counted by itself."""
    c = _col(c)
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(m)))) / len(m) for m in MARKERS), F.lit(0.0)).cast("bigint")


def replaced(c: str | Column, table=None) -> Column:
    """Literal replacements in order."""
    c = _col(c)
    for bad, good in table or REPLACEMENTS:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def strip_tags(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", " ")


def score_of(text: str) -> int:
    return sum(map(text.count, MARKERS))


def repaired(text: str) -> str:
    """P6 on one string: up to two rounds, each taking the re-reading of fewest markers if that is fewer."""
    for _ in range(2):
        readings = [text]
        for encoding in ("cp1252", "latin-1"):
            try:
                readings.append(text.encode(encoding).decode())
            except UnicodeError:
                pass
        best = min(readings, key=score_of)
        if best == text:
            break
        text = best
    return text


def _arrow(fn):
    """A batched function of one string column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return F.pandas_udf(run, "string")


def unescaped(c: str | Column) -> Column:
    """P4, run only on texts with an ampersand."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("&")), _arrow(html.unescape)(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def _as_latin(c: Column) -> Column:
    """A text with cp1252's own characters as the ones that latin-1 has for these bytes, where it has some and cp1252 has bytes for all else.

    Without one, cp1252 and latin-1 give the same bytes, or cp1252 gives none; with one, latin-1 gives none.
    """
    return F.when(~F.rlike(c, F.lit(r"[^\x00-\xFF]")), c).when(~F.rlike(c, F.lit(r"[\x80-\x9F]")), F.translate(c, CP1252, CP1252_BYTES))


def _read_again(c: Column) -> Column:
    """A text's characters as latin-1's bytes, and these as UTF-8; null where that can't be."""
    return F.try_validate_utf8(F.encode(F.when(~F.rlike(c, F.lit(r"[^\x00-\xFF]")), c), "ISO-8859-1").cast("string"))


def repair(df: DataFrame, name: str) -> DataFrame:
    """P6, run only on texts with a marker: the score can only drop where it isn't 0.

    Each step is a column of its own, so that no step is worked out more than once; a text that stayed isn't read again.
    """
    df = df.withColumn("_score", mojibake_score(name))
    for _ in range(2):
        df = df.withColumn("_text", F.when(F.col("_score") > 0, F.col(name))).withColumn("_text", _as_latin(F.col("_text")))
        df = df.withColumn("_text", _read_again(F.col("_text"))).withColumn("_fewer", mojibake_score("_text"))
        better = F.col("_fewer") < F.col("_score")
        df = df.withColumns({name: F.when(better, F.col("_text")).otherwise(F.col(name)), "_score": F.when(better, F.col("_fewer"))})
    return df.drop("_score", "_text", "_fewer")


def clean(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Entities, mojibake, replacements, tags, white space. Steps are columns of their own, so that Python runs once."""
    out = out or name
    df = df.withColumn(out, unescaped(F.coalesce(F.col(name), F.lit(""))))
    return repair(df, out).withColumn(out, collapse(strip_tags(replaced(out))))


def clean_mojibake(df: DataFrame, columns: list[str]) -> DataFrame:
    """P10: chosen columns repaired, with plain marks for typographic ones and single spaces; entities and tags stay."""
    for c in columns:
        df = repair(df.withColumn(c, F.coalesce(F.col(c), F.lit(""))), c)
    return df.withColumns({c: collapse(replaced(c)) for c in columns})


def without_boilerplate(c: str | Column) -> Column:
    """P12."""
    c = _col(c)
    for pattern in BOILERPLATE:
        c = F.regexp_replace(c, "(?iu)" + pattern, " ")
    return collapse(c)


def strip_dateline(df: DataFrame, name: str) -> DataFrame:
    """Up to three rounds of leading navigation and dateline; only the first 180 characters are looked at.

    Each step is a column of its own, so that no step is worked out more than once.
    """
    for _ in range(3):
        for choices in ((NAVIGATION,), DATELINES):
            head = F.substring(name, 1, HEAD)
            cut = F.coalesce(*[F.nullif(F.length(F.regexp_extract(head, p, 0)), F.lit(0)) for p in choices], F.lit(0))
            df = df.withColumn("_cut", cut).withColumn(name, F.substr(F.col(name), F.col("_cut") + 1)).drop("_cut")
    return df.withColumn(name, F.ltrim(name))


def canonical_url(c: str | Column) -> Column:
    """No fragment, no tracking keys, lower-case scheme and host, single slashes, none at the end."""
    raw = F.trim(F.coalesce(_col(c), F.lit("")))
    whole = F.split_part(raw, F.lit("#"), F.lit(1))
    head = F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$", 1)
    part = lambda i: F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$", i)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    coded = F.transform(pairs, lambda p: F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("="), F.replace(F.regexp_replace(p, "^[^=]*=?", ""), F.lit("%20"), F.lit("+"))))
    query = F.array_join(coded, "&")
    path = F.regexp_replace(F.regexp_replace(part(3), "/+", "/"), "/$", "")
    return F.when(head == "", whole).otherwise(F.concat(F.lower(head), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def host(c: str | Column) -> Column:
    """P14."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def slug(c: str | Column) -> Column:
    """P15."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def distinct_sentences(df: DataFrame, name: str) -> DataFrame:
    """White space collapsed, texts that begin with "related" emptied, sentences once each in any case, in order."""
    df = df.withColumn(name, collapse(name)).withColumn("_s", F.filter(F.split(name, r"(?<=[.!?])\s+"), lambda s: s != ""))
    # sorted by key and place, a sentence is the first of its key if the one before has another
    df = df.withColumn("_k", F.array_sort(F.transform("_s", lambda s, i: F.struct(F.lower(s).alias("k"), i.alias("i"), s.alias("s")))))
    df = df.withColumn("_f", F.filter("_k", lambda x, i: (i == 0) | (x["k"] != F.get("_k", i - 1)["k"])))
    df = df.withColumn("_k", F.transform(F.array_sort(F.transform("_f", lambda x: F.struct(x["i"], x["s"].alias("s")))), lambda x: x["s"]))
    low = F.lower(F.substring(name, 1, 9))
    return df.withColumn(name, F.when((low == "related") | F.startswith(low, F.lit("related ")), "").otherwise(F.array_join("_k", " "))).drop("_s", "_k", "_f")


def match_text(c: str | Column) -> Column:
    """P19."""
    return collapse(F.lower(replaced(F.coalesce(_col(c), F.lit("")), MATCH_REPLACEMENTS)))


def fingerprint(title: str | Column, body: str | Column) -> Column:
    """P23."""
    return F.sha1(F.concat(F.lower(_col(title)), F.lit("\n"), F.lower(_col(body))))


def first_of(df: DataFrame, key: str | Column, *order: str) -> DataFrame:
    """Of each key the first row in the given order (a key's rows meet in one task only after a local pick)."""
    rows = df.withColumn("_k", _col(key))
    best = rows.groupBy("_k").agg(F.min(F.struct(*order)).alias("_o"))
    return rows.withColumn("_o", F.struct(*order)).join(best, ["_k", "_o"], "left_semi").drop("_k", "_o")
