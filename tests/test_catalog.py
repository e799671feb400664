"""Every registered query, against DuckDB where there is SQL for it."""

import duckdb
import pytest

import __spark_entry__
from lexloom import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in got.columns]
    assert sorted(repr(plain(tuple(r))) for r in rows) == sorted(repr(plain(tuple(r[k] for k in order))) for r in sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["always_match", "name_lookup", "position_gaps", "ungap_positions"])
def test_whole_tables_need_no_index(spark, name, monkeypatch):
    """What is returned as a whole is made from the documents; a written index is opened where there is one."""
    monkeypatch.setattr(catalog, "_OPENED", {})
    monkeypatch.setattr(catalog, "write_index", lambda *_: pytest.fail("wrote an index"))
    got = catalog.queries()[name](spark, SF)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString() and got.count()
