"""Dates from texts, numbers and URLs; what can't be read is null."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In order: a date that two formats could read is read by the first, so the day comes first.
FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d/M/yy", "M/d/yyyy", "M/d/yy")


def parsed(c: str | Column) -> Column:
    """D2."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    shape = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yy": r"^\d{1,2}/\d{1,2}/\d{2}$"}
    return F.coalesce(*[F.when(F.rlike(c, F.lit(shape.get(f) or shape[f.rpartition("/")[2]])), F.to_date(F.try_to_timestamp(c, F.lit(f)))) for f in FORMATS])


def moment(c: str | Column) -> Column:
    """ISO texts, epoch seconds, or milliseconds above 1e12; in UTC."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("double")
    return F.coalesce(F.timestamp_millis(F.when(number > 1e12, number).cast("bigint")), F.timestamp_seconds(F.when(number <= 1e12, number)), F.try_to_timestamp(c))


def url_date(c: str | Column) -> Column:
    """D7."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(c, r"(\d{4}/\d{2}/\d{2})", 1), "/", "-"), F.lit("yyyy-MM-dd")))


def tumbling(df: DataFrame, day: str, days: int) -> DataFrame:
    """Windows of ``days`` days over the dates of ``df``, from its first to its last, which clips the last; each with its rows.

    A row's window follows from its distance to the first date, so rows are only counted, by window; empty windows stay.
    """
    ends = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    start = ends.select("last", F.explode(F.sequence("first", "last", F.make_dt_interval(F.lit(days)))).alias("window_start"))
    windows = start.select("window_start", F.least(F.date_add("window_start", days - 1), "last").alias("window_end"))
    rows = df.join(F.broadcast(ends)).groupBy(F.date_add("first", (F.floor(F.datediff(day, "first") / days) * days).cast("int")).alias("window_start")).agg(F.count("*").alias("n_rows"))
    return windows.join(rows, "window_start", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


# Names of months and week days, in English.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: A time of day at the end, with its zone or offset; it doesn't move the date.
_TIME = r"(?:[t ]| at )(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)? ?(?:[ap]m)? ?(?:z|utc|gmt|[a-z]{3,4}|(?:gmt|utc)?[+-]\d{2}:?(?:\d{2})?)?(?: \([^)]*\))?$"
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?") + r")\.?"
_SEP, _YEAR = r"[-/. ]{0,2}", r"(\d{4}|'?\d{2})"
#: Shapes by what their groups mean: year, month, day, week, day of week or of year; n is a month's name, a and b are numbers
#: of which either may be the month.
SHAPES = (
    (r"^(\d{4})([-/. ])(\d{1,2})\2(\d{1,2})$", "y_md"),
    (r"^(\d{4})(\d{2})(\d{2})$", "ymd"),
    (r"^(\d{4})-?w(\d{2})-?([1-7])$", "ywk"),
    (r"^(\d{4})-?w(\d{2})$", "yw"),
    (r"^(\d{4})-(\d{3})$", "yo"),
    (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2{_YEAR}$", "a_by"),
    (rf"^(\d{{1,2}}){_SEP}{_MONTH}{_SEP}{_YEAR}$", "dny"),
    (rf"^{_MONTH}{_SEP}(\d{{1,2}})[-/. ]{{1,2}}{_YEAR}$", "ndy"),
    (rf"^(\d{{4}}){_SEP}{_MONTH}{_SEP}(\d{{1,2}})$", "ynd"),
    (rf"^{_MONTH}{_SEP}(\d{{4}})$", "ny"),
    (rf"^(\d{{4}}){_SEP}{_MONTH}$", "yn"),
    (r"^(\d{4})[-/.](\d{1,2})$", "ym"),
    (r"^(\d{1,2})[-/.](\d{4})$", "my"),
    (r"^(\d{4})$", "y"),
)


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    shown = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(shown, F.lit("yyyy-MM-dd")))


def generic(c: str | Column, pivot: int = 69) -> Column:
    """Dates as people and machines write them; what is none is null.

    In any case and with any white space: numbers with one separator (the month before the day, unless it can't be one), ISO
    dates with or without separators, by week and by day of the year, English names of months before or behind the day,
    ordinals, a week day before, a time and an offset behind (the date is the one written). A month without a day is its first
    day, a year its first. Two-digit years below ``pivot`` are 2000 and later, others 1900 and later.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.trim(F.regexp_replace(c, r"[\s,]+", " ")))
    text = F.regexp_replace(text, r"^(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + r")\.? ", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _TIME, ""), r"(?<=\d)(?:st|nd|rd|th)\b", ""), r"\bof ", "")
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)])

    def read(text: Column, pattern: str, roles: str) -> Column:
        got = {}
        for i, role in enumerate(roles, 1):
            part = F.regexp_extract(text, pattern, i)
            if role == "n":
                got["m"] = number[F.substring(part, 1, 3)]
            elif role == "y":
                digits = F.regexp_replace(part, "'", "")
                year = digits.try_cast("int")
                got["y"] = F.when(F.length(digits) > 2, year).otherwise(year + F.when(year < pivot, 2000).otherwise(1900))
            elif role != "_":
                got[role] = part.try_cast("int")
        one = F.lit(1)
        if "w" in got:
            monday = F.date_add(F.date_trunc("week", _day(got["y"], one, F.lit(4))).cast("date"), (got["w"] - 1) * 7)
            return F.when(F.weekofyear(monday) == got["w"], F.date_add(monday, got.get("k", one) - 1))
        if "o" in got:
            day = F.date_add(_day(got["y"], one, one), got["o"] - 1)
            return F.when(F.year(day) == got["y"], day)
        if "a" in got:
            return F.coalesce(_day(got["y"], got["a"], got["b"]), _day(got["y"], got["b"], got["a"]))
        return _day(got["y"], got.get("m", one), got.get("d", one))

    # bound to a name of its own, the text is made once and not in each shape
    return F.get(F.transform(F.array(text), lambda t: F.coalesce(*[F.when(F.rlike(t, F.lit(p)), read(t, p, roles)) for p, roles in SHAPES])), F.lit(0))


def normalised(c: str | Column) -> Column:
    """D2 whole: the five formats in their order, then any other date."""
    return F.coalesce(parsed(c), generic(c))


def cutoff(months: int, start: datetime.date | str | None = None, today: datetime.date | None = None) -> datetime.date:
    """A given first day, or so many times 30 days before today."""
    if start is not None:
        return start if isinstance(start, datetime.date) else datetime.date.fromisoformat(start)
    return (today or datetime.date.today()) - datetime.timedelta(days=30 * months)
