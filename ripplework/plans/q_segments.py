"""Queries on segments: making, aggregating, scoring, selecting, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.operators import segments as seg
from ripplework.operators import selection as sel
from ripplework.plans.registry import SEGMENTS, SIGNAL, query, round_all, rounded
from ripplework.sources import signals

CFG = seg.EVENTS


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.events_signal(spark, sf_dir)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.aggregate_segments(_signal(spark, sf_dir), CFG.segment_len, CFG.hop)


@query(f"SELECT rec_id, segment_index, {rounded(chr(34) + 'start' + chr(34) + ' ' + chr(34) + 'end' + chr(34) + ' duration')} FROM segments", SIGNAL, SEGMENTS)
def segments_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(seg.make_segments(seg.durations(_signal(spark, sf_dir)), CFG.segment_len, CFG.hop), "start end duration")


@query('SELECT rec_id, bool_and("start" >= 0 AND "start" < "end" AND "end" <= d + 1e-6) AS valid, count(*) FILTER (nx < "end") AS overlaps, count(*) AS n FROM (SELECT g.*, d.duration AS d, lead("start") OVER (PARTITION BY g.rec_id ORDER BY "start") AS nx FROM segments g JOIN durations d ON g.rec_id = d.rec_id) GROUP BY rec_id', SIGNAL, SEGMENTS)
def segments_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seg.durations(_signal(spark, sf_dir))
    return seg.validate(seg.make_segments(d, CFG.segment_len, CFG.hop), d)


@query('SELECT rec_id, segment_index, s.frame FROM segments g JOIN signal s USING (rec_id) WHERE s.t >= g."start" AND s.t < g."end"', SIGNAL, SEGMENTS)
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    return seg.assign(s, seg.durations(s), CFG.segment_len, CFG.hop).select("rec_id", "segment_index", "frame")


@query(f"SELECT rec_id, segment_index, n, {rounded('x_mean x_std x_max x_min rms voiced_fraction')} FROM segment_stats", SIGNAL, SEGMENTS)
def segment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "x_mean x_std x_max x_min rms voiced_fraction"
    return round_all(_stats(spark, sf_dir), names).select("rec_id", "segment_index", "n", *names.split())


@query("SELECT g.rec_id, g.segment_index, count(s.t) AS events_count, round(CASE WHEN g.duration > 0 THEN count(s.t) / g.duration ELSE 0 END + 1e-9, 6) AS events_per_unit FROM segments g LEFT JOIN signal s ON s.rec_id = g.rec_id AND s.event_type = 'error' AND s.t >= g.\"start\" AND s.t < g.\"end\" GROUP BY g.rec_id, g.segment_index, g.duration", SIGNAL, SEGMENTS)
def segment_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    made = seg.make_segments(seg.durations(s), CFG.segment_len, CFG.hop)
    counts = seg.count_events(made, s.where("event_type = 'error'").select("rec_id", "t"), CFG.segment_len, CFG.hop)
    return round_all(counts.select("rec_id", "segment_index", "events_count", "events_per_unit"), "events_per_unit")


@query("SELECT g.rec_id, count(*) AS segments, round(sum(g.duration) + 1e-9, 6) AS covered, round(sum(g.duration) / max(d.duration) + 1e-9, 6) AS ratio FROM segments g JOIN durations d ON g.rec_id = d.rec_id GROUP BY g.rec_id", SIGNAL, SEGMENTS)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seg.durations(_signal(spark, sf_dir))
    return round_all(seg.coverage(seg.make_segments(d, CFG.segment_len, CFG.hop), d), "covered ratio")


@query("SELECT rec_id, count(*) AS frames, round(max(f * 512 / 22050e0) + 1e-9, 6) AS last FROM (SELECT rec_id, unnest(range(0, CAST(floor(d * 22050 / 512) AS BIGINT))) AS f FROM (SELECT rec_id, max(t) AS d FROM signal GROUP BY rec_id)) GROUP BY rec_id", SIGNAL)
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = seg.frame_times(seg.durations(_signal(spark, sf_dir)))
    return round_all(f.groupBy("rec_id").agg(F.count("*").alias("frames"), F.max("t").alias("last")), "last")


def scored_sql(table: str) -> str:
    scaled = lambda c: f"CASE WHEN max({c}) OVER r = min({c}) OVER r THEN 1 ELSE ({c} - min({c}) OVER r) / (max({c}) OVER r - min({c}) OVER r) END"
    return f"SELECT *, 0.6e0 * {scaled('rms_')} + 0.4e0 * {scaled('voiced_')} AS score FROM (SELECT *, coalesce(rms, 0) AS rms_, coalesce(voiced_fraction, 0) AS voiced_ FROM {table}) WINDOW r AS (PARTITION BY rec_id)"


@query(f"SELECT rec_id, segment_index, {rounded('score')} FROM ({scored_sql('segment_stats')})", SIGNAL, SEGMENTS)
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sel.importance(_stats(spark, sf_dir)).select("rec_id", "segment_index", "score"), "score")


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY segment_index) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS total FROM segment_stats)"
_SELECTED = f"""{_PLACED}, middle AS (SELECT * FROM placed WHERE total > 12 AND i >= 3 AND i < total - 3), scored AS ({scored_sql('middle')}),
best AS (SELECT rec_id, segment_index, score FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(score, 9) DESC, segment_index) AS k FROM scored) WHERE k <= 6),
selected AS (SELECT rec_id, segment_index, NULL::DOUBLE AS score FROM placed WHERE total <= 12 OR i < 3 OR i >= total - 3 UNION ALL SELECT * FROM best)"""


@query("SELECT rec_id, segment_index, round(score + 1e-9, 6) AS score FROM selected", SIGNAL, SEGMENTS, _SELECTED)
def select_boundary_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sel.boundary_importance(_stats(spark, sf_dir), CFG.max_seq_len, CFG.k_start, CFG.k_end)
    return round_all(kept.select("rec_id", "segment_index", "score"), "score")


@query("SELECT rec_id, segment_index FROM placed WHERE total <= 12 OR i < 8 OR i >= total - 4", SIGNAL, SEGMENTS, _PLACED)
def select_boundary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.boundary_importance(_stats(spark, sf_dir), CFG.max_seq_len, 8, 6).select("rec_id", "segment_index")


@query("SELECT rec_id, segment_index FROM placed WHERE total <= 5 OR i IN (SELECT CAST(floor(j * total / 5) AS BIGINT) FROM (SELECT unnest(range(0, 5)) AS j))", SIGNAL, SEGMENTS, _PLACED)
def select_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(_stats(spark, sf_dir), "uniform", 5).select("rec_id", "segment_index")


@query()
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(_stats(spark, sf_dir), "random", 5).select("rec_id", "segment_index")


@query()
def stochastic_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.replace_some(_stats(spark, sf_dir), 0.2).select("rec_id", "segment_index", "source")


_GRID = "grid AS (SELECT rec_id, unnest(range(0, 20)) AS pos FROM (SELECT DISTINCT rec_id FROM placed))"


@query("SELECT g.rec_id, g.pos, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS mask FROM grid g LEFT JOIN placed p ON g.rec_id = p.rec_id AND g.pos = p.i", SIGNAL, SEGMENTS, _PLACED, _GRID)
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.padded(_stats(spark, sf_dir), 20, ()).select("rec_id", "pos", "mask")


@query("SELECT g.rec_id, g.pos, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS mask, round(coalesce(p.rms, 0) + 1e-9, 6) AS rms, round(coalesce(p.voiced_fraction, 0) + 1e-9, 6) AS voiced_fraction FROM grid g LEFT JOIN placed p ON g.rec_id = p.rec_id AND g.pos = p.i", SIGNAL, SEGMENTS, _PLACED, _GRID)
def pad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sel.padded(_stats(spark, sf_dir), 20, ("rms", "voiced_fraction")), "rms voiced_fraction")


@query("SELECT vec_id, CAST(c AS BIGINT) AS pos, round(CASE c WHEN 0 THEN vec_id WHEN 1 THEN 0 ELSE coalesce(embedding[c - 1], 0) END + 1e-9, 6) AS v FROM embeddings, (SELECT unnest(range(0, 70)) AS c)")
def flatten_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signals.table(spark, sf_dir, "embeddings")
    flat = sel.flatten([F.col("vec_id"), F.lit(None)], [F.col("embedding")], [], 70)  # the last four are padding
    return round_all(e.select("vec_id", F.posexplode(flat).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v")), "v")


@query("SELECT CAST(19 + 128 + 64 + 128 + 64 + 13 AS BIGINT) AS width")
def feature_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = seg.SegmentConfig()
    return spark.range(1).select(F.lit(sel.feature_width(c.pca_dims, c.n_mels, c.n_mfcc)).cast("long").alias("width"))


@query("SELECT rec_id, frame, round(CASE WHEN high = low THEN 1 ELSE (x - low) / (high - low) END + 1e-9, 6) AS scaled FROM (SELECT *, min(x) OVER (PARTITION BY rec_id) AS low, max(x) OVER (PARTITION BY rec_id) AS high FROM signal)", SIGNAL)
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    return round_all(s.select("rec_id", "frame", sel.min_max(s, "x").alias("scaled")), "scaled")


@query("SELECT rec_id, frame, round(x / greatest(max(abs(x)) OVER (PARTITION BY rec_id), 1e-8) + 1e-9, 6) AS y FROM signal", SIGNAL)
def peak_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(_signal(spark, sf_dir).select("rec_id", "frame", sel.peak_normalise("x").alias("y")), "y")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS BIGINT) AS batch FROM orders")
def dataloader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.batches(signals.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 32)


@query()
def dataloader_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.batches(signals.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 32, shuffle=True)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.newest(signals.table(spark, sf_dir, "events"), 10, "user_id", "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_totalprice FROM orders")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.table(spark, sf_dir, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), "o_totalprice")
    return sel.queue(rows, "priority", "o_orderkey")


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC) > 1000 AS evicted FROM events")
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.evicted(signals.table(spark, sf_dir, "events"), "value", "event_id", 1000.0, "user_id").select("user_id", "event_id", "evicted")
