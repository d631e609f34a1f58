"""Every catalogue query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weftlink import catalog, catalog_files, oracle

DATA = "/root/testdata/sf0.001"


def plain(df):
    fix = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = [tuple(fix(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    known = catalog.queries() | catalog_files.queries()
    ours, theirs = known[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize(("mode", "cap", "keep"), [("first", 8, 3), ("skip", 8, 0), ("truncate", 8, 8)])
def test_caps_that_bite(spark, duck, monkeypatch, mode, cap, keep):
    """The caps of the queries are those of the workflow, which few keys of small tables reach."""
    whole = duck.sql(oracle.queries()["block_join_truncate"]).df()
    monkeypatch.setitem(oracle.CAPS, mode, (cap, keep))
    monkeypatch.setitem(catalog.CAPS, mode, catalog.CAPS[mode].with_(cap=cap, cap_take=keep))
    name = {"first": "block_join_capped"}.get(mode, f"block_join_{mode}")
    ours, theirs = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(oracle.queries()[name]).df()
    assert plain(ours) == plain(theirs) and len(ours) < len(whole)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["source1_entity_id", "matched_entity_ids", "candidate_entity_ids"] and out.count() > 0
