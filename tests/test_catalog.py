"""Every query with SQL against DuckDB, and those without for their rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidewire.plans.catalog import ORACLES, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert _rows(frame.columns, rows) == _rows(want.columns, want.fetchall())


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() == 12


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_prompts_hold_the_whole_title(spark, tmp_path):
    docs = [(i, "a" * 300 + tail + ". Rest", "s", "en") for i, tail in enumerate("xy")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.prompt_md5 for r in QUERIES["prompt_render"](spark, str(tmp_path)).collect()}) == 2


def test_replacements_meet_quotes(spark, sf_dir):
    rows = QUERIES["literal_replacements"](spark, sf_dir).where("doc_id % 3 = 0 AND text IS NOT NULL").collect()
    assert rows and all(r.text.endswith("cafÃ© \"x\" it's £") for r in rows)
