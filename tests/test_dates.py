"""Dates in many shapes, against the days they mean."""

from __future__ import annotations

import datetime

import pytest

from tidewire.functions import dates as D

D31 = datetime.date(2024, 1, 31)
CASES = {
    "2024-01-31": D31, " 2024/1/31 ": D31, "2024.01.31": D31, "20240131": D31, "2024-W05-3": D31, "2024w053": D31, "2024-W05": datetime.date(2024, 1, 29), "2024-031": D31,
    "31 January 2024": D31, "31 jan. 2024": D31, "31-Jan-24": D31, "31Jan2024": D31, "Jan 31, 2024": D31, "JANUARY 31ST,  2024": D31, "31st of January 2024": D31, "Wed, 31 Jan 2024 10:20:30 GMT": D31,
    "Wednesday, January 31, 2024 at 9:05 PM": D31, "2024-01-31T23:59:59.123+08:00": D31, "2024-01-31 00:00:00Z": D31, "2024-01-31T10:20": D31, "Wed Jan 31 2024 10:20:30 GMT+0800 (Some Time)": D31, "2024 Jan 31": D31, "31.01.2024": D31, "1.31.2024": D31, "1-31-2024": D31, "31 '": None,
    "02.03.2024": datetime.date(2024, 2, 3), "May 2024": datetime.date(2024, 5, 1), "Sept 5 2024": datetime.date(2024, 9, 5), "5 september 68": datetime.date(2068, 9, 5), "5 sep 69": datetime.date(1969, 9, 5), "5 Sep '24": datetime.date(2024, 9, 5), "2024": datetime.date(2024, 1, 1), "2024-07": datetime.date(2024, 7, 1), "07/2024": datetime.date(2024, 7, 1),
    "29 Feb 2024": datetime.date(2024, 2, 29), "29 Feb 2023": None, "2023-02-30": None, "31.31.2024": None, "2024-366": datetime.date(2024, 12, 31), "2023-366": None, "2020-W53-7": datetime.date(2021, 1, 3), "2021-W53-1": None, "2024-W00": None,
    "": None, "soon": None, "Marchember 3 2024": None, "10:20": None, "2024-01-31 25:00": None, "Jan 31": None, "31": None, "0000-00-00": None, None: None,
}


def test_shapes(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "raw string")
    got = {r.raw: r.day for r in df.select("raw", D.generic("raw").alias("day")).collect()}
    assert got == CASES


def test_formats_come_first(spark):
    df = spark.createDataFrame([("02/03/2024",), ("3/25/2024",), ("02.03.2024",), ("x",)], "raw string")
    got = [r.day for r in df.select(D.normalised("raw").alias("day")).collect()]
    assert got == [datetime.date(2024, 3, 2), datetime.date(2024, 3, 25), datetime.date(2024, 2, 3), None]


def test_cutoff():
    today = datetime.date(2024, 7, 1)
    assert D.cutoff(2, today=today) == datetime.date(2024, 5, 2) and D.cutoff(9, "2024-01-31") == D.cutoff(9, D31) == D31
    with pytest.raises(ValueError):
        D.cutoff(1, "soon")
