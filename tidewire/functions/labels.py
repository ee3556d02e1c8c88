"""Label normalisers: one a purpose, as they differ in vocabulary, precedence and default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Fixed values.
GOLD = {"-1": "negative", "0": "neutral", "1": "positive", "neg": "negative", "neut": "neutral", "neu": "neutral", "pos": "positive", "negative": "negative", "neutral": "neutral", "positive": "positive", "bearish": "negative", "mixed": "neutral", "bullish": "positive"}
TRAINING = {"negative": 0, "bearish": 0, "-1": 0, "neutral": 1, "0": 1, "positive": 2, "bullish": 2, "1": 2}


def _words(text: Column, *choices: tuple[str, str]) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit(r"\b(?:" + words + r")\b")), label) for words, label in choices])


def _lookup(text: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[text]


def corpus(c) -> Column:
    """L1: words, negative first."""
    return F.coalesce(_words(F.lower(collapse(c)), ("negative|neg", "negative"), ("neutral|neu", "neutral"), ("positive|pos", "positive")), F.lit(""))


def gold(c) -> Column:
    """L2: a table, then words."""
    text = F.lower(collapse(c))
    return F.coalesce(_lookup(text, GOLD), _words(text, ("negative|neg|bearish", "negative"), ("neutral|neut|mixed", "neutral"), ("positive|pos|bullish", "positive")), F.lit(""))


def generated(c) -> Column:
    """L3: anywhere in the text, positive first; neutral by default."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(F.contains(text, F.lit("positive")), "positive").when(F.contains(text, F.lit("negative")), "negative").otherwise("neutral")


def chat(c) -> Column:
    """L4: a label, a JSON object with one, a word, then anywhere in the text."""
    text = F.lower(collapse(c))

    def plain(t: Column) -> Column:
        has = lambda *w: F.rlike(t, F.lit("|".join(w)))
        return F.coalesce(F.when(t.isin("pos", "neg", "neut"), t), _words(t, ("pos", "pos"), ("neg", "neg"), ("neut", "neut")), F.when(has("positive", "bullish"), "pos"), F.when(has("negative", "bearish"), "neg"), F.when(has("neutral", "mixed"), "neut"))

    inner = F.when(F.rlike(text, F.lit(r"^\{.*\}$")), F.get_json_object(text, "$.label"))
    return F.coalesce(plain(F.lower(collapse(inner))), plain(text), F.lit(""))


def training(c) -> Column:
    """0, 1 or 2; any other label fails the query."""
    text = F.lower(collapse(c))
    found = _lookup(text, TRAINING)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), text)).cast("int")).otherwise(found)


def score(c) -> Column:
    """L6."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "positive", 1.0).when(c == "negative", -1.0).otherwise(0.0)


def probability_score(positive: str, negative: str) -> Column:
    """L7."""
    return F.coalesce(F.col(positive), F.lit(0.0)) - F.coalesce(F.col(negative), F.lit(0.0))
