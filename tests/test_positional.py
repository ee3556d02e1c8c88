"""CSV files without a fixed shape."""

from __future__ import annotations

from tidewire.sources import readers


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Date,TEXT\n2024-01-01,"x, ""y""\nz",extra,more\n\n2024-01-02\n , \n,only text\ndate,text\n'.encode())
    (tmp_path / "b.csv").write_text("2024-01-03, no header \n﻿2024-01-04,b\n")
    got = sorted(map(tuple, readers.positional(spark, f"{tmp_path}/*.csv").collect()))
    assert got == [("", "only text"), ("2024-01-01", 'x, "y"\nz'), ("2024-01-02", ""), ("2024-01-03", "no header"), ("2024-01-04", "b"), ("date", "text")]
    (tmp_path / "c.csv").write_text("a,b\n1,2,3,4\n")
    assert sorted(map(tuple, readers.positional(spark, f"{tmp_path}/c.csv", ("k", "v", "w")).collect())) == [("1", "2", "3"), ("a", "b", "")]
