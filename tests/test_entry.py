import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.catalog.Q if n != "gbt_scores"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, d)
    rows, cols = got.collect(), sorted(got.columns)
    assert rows or name in ("matched_volume_tau",)
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "part", "embeddings"):
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        names = want.columns
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)
