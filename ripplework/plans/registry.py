"""How queries are registered: a function of (spark, sf_dir), and SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: CTEs that SQL texts share.
SIGNAL = """signal AS (
  SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000e0 AS t,
    value AS x, event_type, event_type IN ('view', 'click') AS voiced
  FROM events)"""
INTERVALS = """intervals AS (
  SELECT conv_id AS rec_id, turn, coalesce(role, 'unknown') AS speaker,
    CAST(coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
    CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS "end"
  FROM conversations)"""
VECTORS = """vectors AS (
  SELECT vec_id AS rec_id, label, CAST(pos - 1 AS INTEGER) AS pos, CAST(embedding[pos] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"""
SEGMENTS = """durations AS (SELECT rec_id, max(t) AS duration FROM signal GROUP BY rec_id),
segments AS (
  SELECT rec_id, k AS segment_index, k * 1.5e0 AS "start", least(k * 1.5e0 + 3.0e0, duration) AS "end", least(k * 1.5e0 + 3.0e0, duration) - k * 1.5e0 AS duration
  FROM (SELECT rec_id, duration, unnest(range(0, CASE WHEN duration < 3.0 THEN 1 ELSE CAST(floor((duration - 3.0e0 + 1e-6) / 1.5e0) AS BIGINT) + 1 END)) AS k FROM durations WHERE duration > 0)),
segment_stats AS (
  SELECT g.rec_id, g.segment_index, g."start", g."end", g.duration, count(s.x) AS n, avg(s.x) AS x_mean, stddev_pop(s.x) AS x_std, max(s.x) AS x_max, min(s.x) AS x_min,
    sqrt(avg(s.x * s.x)) AS rms, coalesce(avg(CASE WHEN s.voiced THEN 1.0e0 WHEN s.voiced IS NOT NULL THEN 0.0e0 END), 0) AS voiced_fraction
  FROM segments g LEFT JOIN signal s ON s.rec_id = g.rec_id AND s.t >= g."start" AND s.t < g."end"
  GROUP BY ALL)"""


def query(sql: str | None = None, *ctes: str) -> Callable:
    """Register a function under its name; ctes go before the SQL, which then has none of its own or begins with a comma."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


#: Added before rounding, so that exact halves, which sums in another order miss by a hair, round alike in both engines.
NUDGE = 1e-9


def rounded(columns: str, digits: int = 6) -> str:
    """SQL that rounds each named column."""
    return ", ".join(f"round({c} + {NUDGE:.0e}, {digits}) AS {c}" for c in columns.split())


def round_all(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """The same in Spark."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in columns.split()})
