"""Queries of this subpackage that have SQL, against it."""

import duckdb
import pytest

from ripplework.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = entries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in entries.QUERIES] == list(range(1, 11))
