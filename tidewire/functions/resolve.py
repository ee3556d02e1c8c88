"""Column names and arguments, resolved on the driver: nothing here reads data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def exact(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column, in any case; of columns that differ by case only, the last."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def fuzzy(columns: Sequence[str], candidates: Sequence[str], contained: Iterable[str] = ("adj close", "close", "date")) -> str | None:
    """Exactly, or else the first column that begins with a candidate and a break, or holds one of ``contained``."""
    if found := exact(columns, candidates):
        return found
    loose = {c.lower() for c in contained}
    for name in (c.lower() for c in candidates):
        for column in columns:
            low = column.lower()
            if low.startswith((f"{name} ", f"{name}_")) or name in loose and name in low:
                return column
    return None


def flat_headers(df: DataFrame) -> DataFrame:
    """Names without outer blanks, repeated ones numbered from _2."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = " ".join(c.split())
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def label_column(columns: Sequence[str]) -> str | None:
    """C4: the first that ends in _label, else label or sentiment."""
    return next((c for c in columns if c.lower().endswith("_label")), None) or exact(columns, ("label", "sentiment"))


def probability_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """C4: the last that hold prob_positive and prob_negative."""
    pick = lambda part: next((c for c in reversed(columns) if part in c.lower()), None)
    return pick("prob_positive"), pick("prob_negative")


def sentiment_columns(columns: Sequence[str]) -> list[str]:
    """Those that a corpus carries along."""
    return [c for c in columns if "sentiment" in c.lower() or "label" in c.lower() and re.search("finbert|fingpt", c.lower())]


def ordered_unique(values: Iterable[str]) -> list[str]:
    """Arguments, repeated or comma-separated, once each in order."""
    return list(dict.fromkeys(p.strip() for v in values for p in v.split(",") if p.strip()))


def lags(values: Iterable[str]) -> list[int]:
    """Distinct lags of 0 or more, sorted."""
    found = sorted({int(v) for v in ordered_unique(values)})
    if not found or found[0] < 0:
        raise ValueError("lags must be 0 or more")
    return found


def slug(value: str) -> str:
    return re.sub("[^a-z0-9]+", "_", value.lower()).strip("_")


def safe_name(value: str) -> str:
    """A file name of a path's stem."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", Path(value).stem).strip("_")
