"""Queries on ordered rows: differences, windows, runs, clusters, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplework.operators import segments, sequence
from ripplework.plans.registry import INTERVALS, SIGNAL, query, round_all, rounded
from ripplework.sources import signals

_W = "WINDOW w AS (PARTITION BY rec_id ORDER BY frame)"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.events_signal(spark, sf_dir)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.intervals_from_turns(signals.table(spark, sf_dir, "conversations"))


@query(f"SELECT rec_id, frame, {rounded('roll_mean')} FROM (SELECT rec_id, frame, sum(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS roll_mean FROM signal)", SIGNAL)
def rolling_mean_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.rolling(_signal(spark, sf_dir), "x", 5, ("mean",)).select("rec_id", "frame", "roll_mean"), "roll_mean")


@query(f"SELECT rec_id, frame, {rounded('roll_std')} FROM (SELECT rec_id, frame, stddev_pop(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS roll_std FROM signal)", SIGNAL)
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.rolling(_signal(spark, sf_dir), "x", 5, ("std", "none")).select("rec_id", "frame", "roll_std"), "roll_std")


@query("SELECT rec_id, frame, min(x) OVER w AS roll_min, max(x) OVER w AS roll_max FROM signal WINDOW w AS (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", SIGNAL)
def rolling_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.rolling(_signal(spark, sf_dir), "x", 7, ("min", "max")).select("rec_id", "frame", "roll_min", "roll_max")


@query(f"SELECT rec_id, {rounded('variation stability mean')} FROM (SELECT rec_id, stddev_pop(d) AS variation, 1 / (1 + stddev_pop(d)) AS stability, avg(d) AS mean FROM (SELECT rec_id, x - lag(x) OVER w AS d FROM signal {_W}) WHERE d IS NOT NULL GROUP BY rec_id)", SIGNAL)
def first_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _signal(spark, sf_dir).withColumn("d", sequence.difference("x", sequence.ordered())).where("d IS NOT NULL")
    one = d.groupBy("rec_id").agg(F.stddev_pop("d").alias("variation"), (1 / (1 + F.stddev_pop("d"))).alias("stability"), F.avg("d").alias("mean"))
    return round_all(one, "variation stability mean")


@query(
    f""", d AS (SELECT rec_id, frame, CASE WHEN n IS NOT NULL AND p IS NOT NULL THEN (n - p) / 2 WHEN n IS NOT NULL THEN n - x WHEN p IS NOT NULL THEN x - p ELSE 0 END AS delta FROM (SELECT *, lead(x) OVER w AS n, lag(x) OVER w AS p FROM signal {_W}))
    SELECT rec_id, frame, {rounded('delta delta2')} FROM (SELECT rec_id, frame, delta, CASE WHEN n IS NOT NULL AND p IS NOT NULL THEN (n - p) / 2 WHEN n IS NOT NULL THEN n - delta WHEN p IS NOT NULL THEN delta - p ELSE 0 END AS delta2 FROM (SELECT *, lead(delta) OVER w AS n, lag(delta) OVER w AS p FROM d {_W}))""",
    SIGNAL,
)
def delta_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.delta(_signal(spark, sf_dir), "x").select("rec_id", "frame", "delta", "delta2"), "delta delta2")


@query(
    f"""SELECT rec_id, {rounded('jitter_local jitter_rap jitter_ppq5 jitter_ddp')} FROM (SELECT rec_id, coalesce(avg(abs(x - p1)) / avg(x), 0) AS jitter_local, coalesce(avg(abs(x - (p1 + x + n1) / 3)) / avg(x), 0) AS jitter_rap,
      coalesce(avg(abs(x - (p2 + p1 + n1 + n2) / 4)) / avg(x), 0) AS jitter_ppq5, 3 * coalesce(avg(abs(x - (p1 + x + n1) / 3)) / avg(x), 0) AS jitter_ddp
    FROM (SELECT rec_id, x, lag(x) OVER w AS p1, lag(x, 2) OVER w AS p2, lead(x) OVER w AS n1, lead(x, 2) OVER w AS n2 FROM signal {_W}) GROUP BY rec_id)""",
    SIGNAL,
)
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.jitter(_signal(spark, sf_dir), "x"), "jitter_local jitter_rap jitter_ppq5 jitter_ddp")


@query(
    f"""SELECT rec_id, {rounded('shimmer_local shimmer_apq3 shimmer_apq5 shimmer_apq11 shimmer_dda')} FROM (SELECT rec_id, coalesce(avg(abs(x - p1)) / avg(x), 0) AS shimmer_local, coalesce(avg(abs(x - (p1 + x + n1) / 3)) / avg(x), 0) AS shimmer_apq3,
      coalesce(avg(abs(x - (p2 + p1 + n1 + n2) / 4)) / avg(x), 0) AS shimmer_apq5, coalesce(avg(CASE WHEN c = 11 THEN abs(x - m) END) / avg(x), 0) AS shimmer_apq11, 3 * coalesce(avg(abs(x - (p1 + x + n1) / 3)) / avg(x), 0) AS shimmer_dda
    FROM (SELECT rec_id, x, lag(x) OVER w AS p1, lag(x, 2) OVER w AS p2, lead(x) OVER w AS n1, lead(x, 2) OVER w AS n2,
      avg(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c FROM signal {_W}) GROUP BY rec_id)""",
    SIGNAL,
)
def shimmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.shimmer(_signal(spark, sf_dir), "x"), "shimmer_local shimmer_apq3 shimmer_apq5 shimmer_apq11 shimmer_dda")


@query("SELECT rec_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS duration_frames, count(*) * 30 AS duration_ms FROM (SELECT rec_id, frame, frame - row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS g FROM signal WHERE voiced) GROUP BY rec_id, g", SIGNAL)
def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.runs(_signal(spark, sf_dir), "voiced").withColumn("duration_ms", F.col("duration_frames") * 30)


@query("SELECT rec_id, count(*) AS n_runs, max(n) AS longest FROM (SELECT rec_id, count(*) AS n FROM (SELECT rec_id, frame - row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS g FROM signal WHERE x >= 100) GROUP BY rec_id, g) GROUP BY rec_id", SIGNAL)
def clip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.runs(_signal(spark, sf_dir).withColumn("clipped", F.col("x") >= 100), "clipped")
    return runs.groupBy("rec_id").agg(F.count("*").alias("n_runs"), F.max("duration_frames").alias("longest"))


@query(f"SELECT rec_id, count(*) FILTER (size > 1) AS n_clusters, {rounded('score')} FROM (SELECT *, count(*) FILTER (size > 2) OVER (PARTITION BY rec_id) / sum(size) OVER (PARTITION BY rec_id) AS score FROM (SELECT rec_id, c, count(*) AS size FROM (SELECT rec_id, sum(CASE WHEN gap > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY frame) AS c FROM (SELECT *, t - lag(t) OVER w AS gap FROM signal {_W})) GROUP BY rec_id, c)) GROUP BY rec_id, score", SIGNAL)
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.cluster_score(sequence.gap_clusters(_signal(spark, sf_dir), 0.5)), "score")


@query(
    f"""SELECT rec_id, label, {rounded('"start" "end"').replace('AS "start"', 'AS "start"')}, frames FROM (SELECT rec_id, label, s AS "start", coalesce(lead(s) OVER (PARTITION BY rec_id ORDER BY g), last) AS "end", frames FROM (
      SELECT rec_id, g, min(label) AS label, min(t) AS s, max(t) AS last, count(*) AS frames FROM (SELECT *, sum(CASE WHEN label = p THEN 0 ELSE 1 END) OVER w AS g FROM (SELECT *, lag(label) OVER w AS p FROM (
        SELECT rec_id, frame, t, CASE WHEN x < 10 THEN 'silence' WHEN x < 40 THEN 'consonant' WHEN x < 90 THEN 'vowel' ELSE 'fricative' END AS label FROM signal) {_W}) {_W}) GROUP BY rec_id, g)) WHERE "end" - "start" > 0.01""",
    SIGNAL,
)
def label_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    label = F.when(x < 10, "silence").when(x < 40, "consonant").when(x < 90, "vowel").otherwise("fricative")
    runs = sequence.label_runs(_signal(spark, sf_dir).withColumn("label", label), "label").where("end - start > 0.01")
    return round_all(runs.select("rec_id", "label", "start", "end", "frames"), "start end")


_HITS = "hits AS (SELECT rec_id, event_type, t AS \"start\", t + 0.2e0 AS \"end\", x AS energy FROM signal WHERE x > 30)"


@query(
    f"""SELECT rec_id, event_type, {rounded('"start" "end"')}, energy, merged FROM (SELECT rec_id, min(event_type) AS event_type, min("start") AS "start", max("end") AS "end", max(energy) AS energy, count(*) AS merged FROM (
      SELECT *, sum(CASE WHEN event_type = pt AND "start" - pe <= 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY "start", "end") AS g FROM (SELECT *, lag(event_type) OVER (PARTITION BY rec_id ORDER BY "start", "end") AS pt, lag("end") OVER (PARTITION BY rec_id ORDER BY "start", "end") AS pe FROM hits)) GROUP BY rec_id, g)""",
    SIGNAL, _HITS,
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _signal(spark, sf_dir).where("x > 30").select("rec_id", "event_type", F.col("t").alias("start"), (F.col("t") + 0.2).alias("end"), F.col("x").alias("energy"))
    return round_all(sequence.merge_intervals(hits, 1.0, "event_type"), "start end")


@query('SELECT rec_id, turn, "start" AS time, p AS "from", speaker AS "to", "start" - pe AS gap FROM (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY turn) AS p, lag("end") OVER (PARTITION BY rec_id ORDER BY turn) AS pe FROM intervals) WHERE p <> speaker', INTERVALS)
def speaker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.changes(_turns(spark, sf_dir), "speaker")


@query(f"SELECT rec_id, changes, {rounded('rate stability')} FROM (SELECT rec_id, count(*) FILTER (event_type <> p) AS changes, count(*) FILTER (event_type <> p) / count(*) AS rate, 1 - count(*) FILTER (event_type <> p) / count(*) AS stability FROM (SELECT *, lag(event_type) OVER w AS p FROM signal {_W}) GROUP BY rec_id)", SIGNAL)
def transition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.transition_rate(_signal(spark, sf_dir), "event_type"), "rate stability")


_GAPS = f"gaps AS (SELECT *, t - lag(t) OVER w AS gap FROM signal {_W})"


@query(f"SELECT rec_id, n, {rounded('mean std min max median variability regularity')} FROM (SELECT rec_id, count(gap) AS n, avg(gap) AS mean, stddev_pop(gap) AS std, min(gap) AS min, max(gap) AS max, quantile_cont(gap, 0.5) AS median, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0 END AS variability, 1 / (1 + CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0 END) AS regularity FROM gaps WHERE gap IS NOT NULL GROUP BY rec_id)", SIGNAL, _GAPS)
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.interval_stats(_signal(spark, sf_dir)), "mean std min max median variability regularity")


@query(
    f"""SELECT rec_id, {rounded('mean std min max acceleration cv stability', 3)} FROM (SELECT rec_id, coalesce(avg(tempo), 0) AS mean, coalesce(stddev_pop(tempo), 0) AS std, coalesce(min(tempo), 0) AS min, coalesce(max(tempo), 0) AS max, coalesce(avg(change), 0) AS acceleration,
      CASE WHEN avg(tempo) > 0 THEN stddev_pop(tempo) / avg(tempo) ELSE 0 END AS cv, 1 / (1 + CASE WHEN avg(tempo) > 0 THEN stddev_pop(tempo) / avg(tempo) ELSE 0 END) AS stability
    FROM (SELECT rec_id, tempo, tempo - lag(tempo) OVER w AS change FROM (SELECT *, CASE WHEN gap > 0 THEN 60 / gap END AS tempo FROM gaps) {_W}) GROUP BY rec_id)""",
    SIGNAL, _GAPS,
)
def local_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.local_tempo(_signal(spark, sf_dir)), "mean std min max acceleration cv stability", 3)


@query(
    f"""SELECT rec_id, n, {rounded('even')}, pairs, {rounded('off')}, CASE WHEN even > 0.7 THEN 'duple' WHEN pairs > n / 4 THEN 'triple' WHEN off > 0.3 THEN 'syncopated' ELSE 'steady' END AS pattern FROM (
      SELECT rec_id, count(*) AS n, count(*) FILTER (rel BETWEEN 0.8 AND 1.2) / count(*) AS even, count(*) FILTER (k % 2 = 0 AND gap > 0 AND nx / gap BETWEEN 1.5 AND 2.5) AS pairs, count(*) FILTER (NOT rel BETWEEN 0.7 AND 1.3) / count(*) AS off
      FROM (SELECT rec_id, gap, row_number() OVER w - 1 AS k, lead(gap) OVER w AS nx, gap / avg(gap) OVER (PARTITION BY rec_id) AS rel FROM gaps WHERE gap IS NOT NULL {_W}) GROUP BY rec_id)""",
    SIGNAL, _GAPS,
)
def rhythm_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.rhythm_pattern(_signal(spark, sf_dir)), "even off")


_METER = f""", scores AS (SELECT rec_id, meter, avg(CASE WHEN m > 0 THEN greatest(0, 1 - s / m) ELSE 0 END) AS score, count(*) AS groups FROM (
      SELECT rec_id, meter, k // meter AS g, avg(gap) AS m, stddev_pop(gap) AS s FROM (SELECT rec_id, gap, row_number() OVER w - 1 AS k FROM gaps WHERE gap IS NOT NULL {_W}), (SELECT unnest([4, 3, 2, 6]) AS meter) GROUP BY rec_id, meter, k // meter HAVING count(*) = meter) GROUP BY rec_id, meter)"""


@query(f"{_METER} SELECT rec_id, CAST(meter AS INTEGER) AS meter, {rounded('score')}, groups FROM scores", SIGNAL, _GAPS)
def meter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.meter_scores(_signal(spark, sf_dir)), "score")


@query(f"{_METER} SELECT rec_id, CAST(arg_max(meter, (score, -list_position([4, 3, 2, 6], meter))) AS INTEGER) AS meter, round(max(score) + 1e-9, 6) AS score FROM scores GROUP BY rec_id", SIGNAL, _GAPS)
def best_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.best_meter(sequence.meter_scores(_signal(spark, sf_dir))), "score")


@query("SELECT rec_id, frame, x FROM (SELECT rec_id, frame, x, max(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS m FROM signal) WHERE x = top AND x >= m + 5", SIGNAL)
def peak_picking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.peaks(_signal(spark, sf_dir), "x", above=5.0).select("rec_id", "frame", "x")


@query(
    """, tops AS (SELECT rec_id, list(frame ORDER BY frame) AS fs FROM (SELECT rec_id, frame, x, max(x) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM signal) WHERE x = top GROUP BY rec_id)
    SELECT rec_id, unnest(list_reduce(list_prepend([-1000000]::BIGINT[], list_transform(fs, lambda f: [f]::BIGINT[])), lambda a, b: CASE WHEN b[1] - a[-1] > 5 THEN list_concat(a, b) ELSE a END)[2:]) AS frame FROM tops""",
    SIGNAL,
)
def spaced_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.peaks(_signal(spark, sf_dir), "x", before=0, after=0)
    return sequence.spaced(found, 5)


@query(
    """, gaps_in AS (SELECT rec_id, frame, CASE WHEN event_type = 'error' THEN NULL ELSE x END AS y FROM signal),
      k AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pf, last_value(y IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS nf, first_value(y IGNORE NULLS) OVER a AS nv
        FROM gaps_in WINDOW b AS (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT rec_id, frame, round(coalesce(y, pv + (nv - pv) * (frame - pf) / (nf - pf)) + 1e-9, 6) AS y_filled FROM k WHERE y IS NOT NULL OR (pf IS NOT NULL AND nf IS NOT NULL)""",
    SIGNAL,
)
def interpolate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signal(spark, sf_dir).select("rec_id", "frame", F.when(F.col("event_type") != "error", F.col("x")).alias("y"))
    filled = sequence.interpolate(rows, "y")
    # SQL has the interior alone
    known = F.when(F.col("y").isNotNull(), F.col("frame"))
    inside = filled.withColumn("a", F.min(known).over(Window.partitionBy("rec_id"))).withColumn("b", F.max(known).over(Window.partitionBy("rec_id"))).where("frame BETWEEN a AND b")
    return round_all(inside.select("rec_id", "frame", "y_filled"), "y_filled")


@query("SELECT rec_id, w AS \"window\", w * 0.5e0 AS \"start\", w * 0.5e0 + 1.0e0 AS \"end\" FROM (SELECT rec_id, unnest(range(0, CAST(ceil((d - 1.0e0) / 0.5e0) AS BIGINT))) AS w FROM (SELECT rec_id, max(t) AS d FROM signal GROUP BY rec_id))", SIGNAL)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fixed_windows(segments.durations(_signal(spark, sf_dir)), 1.0, 0.5)
