"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ripplework.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def query_and_sql(spark, tmp_path):
    """Rows of a query and of its SQL over a table of events."""

    def run(name, events, stored=None):
        """events: a DuckDB query; stored: the same rows as Spark is to find them."""
        folder = tmp_path / name
        folder.mkdir()
        connection = duckdb.connect(config={"threads": 1})
        connection.execute(f"COPY ({stored or events}) TO '{folder}/events.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE TABLE events AS {events}")
        return rows(catalog.QUERIES[name](spark, str(folder)).toPandas()), rows(connection.execute(catalog.ORACLES[name]).df())

    return run


def test_eviction_of_rows_used_at_one_time(sf_dir, query_and_sql):
    got, want = query_and_sql("lru_eviction", f"SELECT * REPLACE (event_id // 2 AS event_id) FROM read_parquet('{sf_dir}/events.parquet'), range(3)")
    assert got == want


@pytest.mark.parametrize("name", ["scene_scores", "event_scores", "emotion_rules"])
def test_means_on_a_threshold(query_and_sql, name):
    """100 users whose values have a mean of 50, which divided by 500 is the rules' 0.1; sums in double precision miss it or not, by their order."""
    cents = "SELECT u, i, CASE WHEN i < 39 THEN c ELSE 200000 - sum(c) FILTER (i < 39) OVER (PARTITION BY u) END AS c FROM (SELECT u, i, CAST(hash(u * 40 + i) % 10000 AS BIGINT) AS c FROM range(100) AS a(u), range(40) AS b(i))"
    events = f"SELECT u * 40 + i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, u AS user_id, CASE WHEN i % 4 = 0 THEN 'error' WHEN i % 4 = 1 THEN 'view' ELSE 'signup' END AS event_type, c / 100e0 AS value, '{{}}' AS props FROM ({cents}) ORDER BY event_id"
    got, want = query_and_sql(name, events, f"SELECT * FROM ({events}) ORDER BY hash(event_id)")
    assert got == want
