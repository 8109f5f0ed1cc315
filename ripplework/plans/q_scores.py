"""Queries for rule-based scores and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplework.functions import scoring as sc
from ripplework.operators import joins
from ripplework.plans.registry import SIGNAL, query, round_all, rounded
from ripplework.sources import signals

# features of a recording on the scale that the rules expect
_FEATURES = """feats AS (SELECT rec_id, avg(x) * 4 AS pitch_mean, stddev_pop(x) AS pitch_std, avg(x) / 500 AS energy_mean, stddev_pop(x) / 1000 AS energy_std, count(*) * 1.5e0 AS tempo,
  count(*) FILTER (event_type = 'error') / count(*) AS zcr_mean, count(*) FILTER (voiced) / count(*) AS pitch_present, stddev_pop(x) * 25 AS centroid_std, avg(x) * 40 AS centroid FROM signal GROUP BY rec_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums run in order of frames. In an order left to chance, a mean that is on a rule's threshold would fall on either side of it.

    Straight from the events: frames and sums then share one shuffle and sort.
    """
    x, so_far = F.col("value"), Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = signals.table(spark, sf_dir, "events").withColumns({"total": F.sum(x).over(so_far), "frame": F.row_number().over(so_far)})
    mean, voiced = F.max_by("total", "frame") / F.count(x), F.col("event_type").isin(*signals.VOICED_TYPES)
    return events.groupBy(F.col("user_id").alias("rec_id")).agg(
        (mean * 4).alias("pitch_mean"), F.stddev_pop(x).alias("pitch_std"), (mean / 500).alias("energy_mean"), (F.stddev_pop(x) / 1000).alias("energy_std"), (F.count("*") * 1.5).alias("tempo"),
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("zcr_mean"), (F.count_if(voiced) / F.count("*")).alias("pitch_present"), (F.stddev_pop(x) * 25).alias("centroid_std"), (mean * 40).alias("centroid"),
    )


# The rules, written out once more in SQL: a wrong threshold on either side shows.
_EVENT_SQL = """
  SELECT rec_id, 0 AS place, 'speech' AS label, (pitch_present > 0.5)::INT * 4 + (energy_mean >= 0.05 AND energy_mean <= 0.2)::INT * 3 + (zcr_mean >= 0.1 AND zcr_mean <= 0.3)::INT * 3 AS tenths FROM feats
  UNION ALL SELECT rec_id, 1, 'music', (pitch_present > 0.5)::INT * 3 + (energy_mean > 0.1)::INT * 3 + (zcr_mean < 0.2)::INT * 4 FROM feats
  UNION ALL SELECT rec_id, 2, 'noise', (pitch_present < 0.3)::INT * 4 + (zcr_mean > 0.3)::INT * 3 + (centroid_std > 1000)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 3, 'silence', (energy_mean < 0.01)::INT * 5 + (pitch_present < 0.1)::INT * 5 FROM feats
  UNION ALL SELECT rec_id, 4, 'environmental', (pitch_present < 0.4)::INT * 3 + (energy_mean >= 0.02 AND energy_mean <= 0.15)::INT * 3 + (zcr_mean >= 0.1 AND zcr_mean <= 0.4)::INT * 4 FROM feats
  UNION ALL SELECT rec_id, 5, 'mechanical', (pitch_present < 0.3)::INT * 3 + (energy_mean > 0.05)::INT * 3 + (zcr_mean > 0.2)::INT * 4 FROM feats
  UNION ALL SELECT rec_id, 6, 'human', (pitch_present > 0.4)::INT * 4 + (energy_mean >= 0.03 AND energy_mean <= 0.2)::INT * 3 + (zcr_mean >= 0.1 AND zcr_mean <= 0.3)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 7, 'alarm', (pitch_present > 0.5)::INT * 3 + (energy_mean > 0.1)::INT * 3 + (zcr_mean < 0.2)::INT * 4 FROM feats"""
_SCENE_SQL = """
  SELECT rec_id, 0 AS place, 'indoor' AS label, (energy_mean < 0.1)::INT * 3 + (pitch_present > 0.3)::INT * 4 + (zcr_mean < 0.3)::INT * 3 AS tenths FROM feats
  UNION ALL SELECT rec_id, 1, 'outdoor', (energy_mean > 0.05)::INT * 3 + (pitch_present < 0.4)::INT * 4 + (zcr_mean > 0.2)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 2, 'transport', (energy_mean > 0.1)::INT * 4 + (pitch_present < 0.3)::INT * 3 + (zcr_mean > 0.3)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 3, 'nature', (energy_mean >= 0.02 AND energy_mean <= 0.1)::INT * 3 + (pitch_present < 0.4)::INT * 4 + (zcr_mean >= 0.1 AND zcr_mean <= 0.4)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 4, 'urban', (energy_mean > 0.08)::INT * 4 + (pitch_present < 0.4)::INT * 3 + (zcr_mean > 0.25)::INT * 3 FROM feats
  UNION ALL SELECT rec_id, 5, 'quiet', (energy_mean < 0.03)::INT * 5 + (zcr_mean < 0.2)::INT * 5 FROM feats
  UNION ALL SELECT rec_id, 6, 'noisy', (energy_mean > 0.1)::INT * 5 + (zcr_mean > 0.3)::INT * 5 FROM feats"""
_EMOTION_SQL = """
  SELECT rec_id, 0 AS place, 'happy' AS label, CASE WHEN pitch_mean > 200 AND energy_mean > 0.1 AND tempo > 120 THEN 4 WHEN pitch_mean > 180 AND energy_mean > 0.08 THEN 2 ELSE 0 END AS tenths FROM feats
  UNION ALL SELECT rec_id, 1, 'sad', CASE WHEN pitch_mean < 150 AND energy_mean < 0.05 AND tempo < 80 THEN 4 WHEN pitch_mean < 170 AND energy_mean < 0.07 THEN 2 ELSE 0 END FROM feats
  UNION ALL SELECT rec_id, 2, 'angry', CASE WHEN pitch_std > 50 AND energy_mean > 0.12 AND tempo > 100 THEN 4 WHEN pitch_std > 40 AND energy_mean > 0.1 THEN 2 ELSE 0 END FROM feats
  UNION ALL SELECT rec_id, 3, 'fearful', CASE WHEN pitch_mean > 220 AND energy_std > 0.05 AND tempo > 110 THEN 4 WHEN pitch_mean > 200 AND energy_std > 0.03 THEN 2 ELSE 0 END FROM feats
  UNION ALL SELECT rec_id, 4, 'surprised', CASE WHEN pitch_mean > 250 AND energy_mean > 0.15 AND tempo > 130 THEN 4 WHEN pitch_mean > 230 AND energy_mean > 0.12 THEN 2 ELSE 0 END FROM feats
  UNION ALL SELECT rec_id, 5, 'disgusted', CASE WHEN pitch_mean < 140 AND energy_mean < 0.04 AND tempo < 70 THEN 4 WHEN pitch_mean < 160 AND energy_mean < 0.06 THEN 2 ELSE 0 END FROM feats
  UNION ALL SELECT rec_id, 6, 'neutral', CASE WHEN pitch_mean BETWEEN 150 AND 200 AND energy_mean BETWEEN 0.06 AND 0.1 AND tempo BETWEEN 80 AND 120 AND pitch_std < 30 THEN 4 ELSE 1 END FROM feats"""


def _shares(scores: str) -> str:
    return f"SELECT rec_id, label, round(CASE WHEN sum(tenths) OVER (PARTITION BY rec_id) > 0 THEN tenths / sum(tenths) OVER (PARTITION BY rec_id) ELSE 0 END + 1e-9, 6) AS share FROM ({scores})"


def _best(scores: str) -> str:
    return f"SELECT rec_id, arg_max(label, tenths * 100 - place) AS label, max(tenths) AS tenths FROM ({scores}) GROUP BY rec_id"


@query(f"SELECT rec_id, label, round(tenths / 10 + 1e-9, 6) AS score FROM ({_EVENT_SQL})", SIGNAL, _FEATURES)
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("rec_id", F.inline(sc.event_scores()))
    return round_all(rows.select("rec_id", "label", "score"), "score")


@query(f"SELECT rec_id, CASE WHEN tenths > 3 THEN label ELSE 'unknown' END AS event_type FROM ({_best(_EVENT_SQL)})", SIGNAL, _FEATURES)
def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("rec_id", sc.best_event(sc.event_scores()).alias("event_type"))


@query(_shares(_SCENE_SQL), SIGNAL, _FEATURES)
def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("rec_id", F.inline(sc.scene_scores()))
    return round_all(rows.select("rec_id", "label", F.col("score").alias("share")), "share")


@query(f"SELECT rec_id, label AS scene FROM ({_best(_SCENE_SQL)})", SIGNAL, _FEATURES)
def scene_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("rec_id", F.array_max(sc.scores(tuple(sc.SCENES), sc.scene_sql))["label"].alias("scene"))


_EMOTIONS = (*sc.EMOTIONS, "neutral")


@query(_shares(_EMOTION_SQL), SIGNAL, _FEATURES)
def emotion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("rec_id", F.inline(sc.emotion_scores()))
    return round_all(rows.select("rec_id", "label", F.col("score").alias("share")), "share")


@query(f"SELECT rec_id, label AS emotion FROM ({_best(_EMOTION_SQL)})", SIGNAL, _FEATURES)
def dominant_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("rec_id", F.array_max(sc.scores(_EMOTIONS, sc.emotion_sql))["label"].alias("emotion"))


@query("SELECT rec_id, round((least(pitch_mean / 300, 1) + least(centroid / 4000, 1)) / 2 + 1e-9, 6) AS valence, round((least(energy_mean / 0.2, 1) + least(tempo / 200, 1)) / 2 + 1e-9, 6) AS arousal FROM feats", SIGNAL, _FEATURES)
def valence_arousal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = features(spark, sf_dir).select("rec_id", sc.valence(c("pitch_mean"), c("centroid")).alias("valence"), sc.arousal(c("energy_mean"), c("tempo")).alias("arousal"))
    return round_all(rows, "valence arousal")


@query("SELECT rec_id, CASE WHEN tempo < 60 THEN 'very_slow' WHEN tempo < 80 THEN 'slow' WHEN tempo < 100 THEN 'moderate' WHEN tempo < 120 THEN 'medium' WHEN tempo < 140 THEN 'fast' WHEN tempo < 180 THEN 'very_fast' ELSE 'extremely_fast' END AS tempo_class FROM feats", SIGNAL, _FEATURES)
def tempo_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("rec_id", sc.tempo_class(F.col("tempo")).alias("tempo_class"))


@query("SELECT rec_id, round(least((stddev_pop(x) / avg(x) + count(*) FILTER (voiced) / count(*)) / 2, 1) + 1e-9, 6) AS complexity FROM signal GROUP BY rec_id", SIGNAL)
def rhythm_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.events_signal(spark, sf_dir).groupBy("rec_id").agg((F.stddev_pop("x") / F.avg("x")).alias("cv"), F.count_if("voiced").alias("onsets"), F.count("*").alias("beats"))
    return round_all(s.select("rec_id", sc.rhythm_complexity(F.col("cv"), F.col("onsets"), F.col("beats")).alias("complexity")), "complexity")


@query("SELECT rec_id, round(greatest(0, least(1, 0.3 * least(20 * log10(pitch_mean / pitch_std) / 40, 1) + 0.25 * greatest(0, 1 - 100 * energy_std / 20) + 0.2 * CASE WHEN zcr_mean > 0.2 THEN 0 ELSE 1 END + 0.15 * CASE WHEN pitch_present > 0.5 THEN 0 ELSE 1 END + 0.1 * greatest(0, least(1, (centroid / 11025 + centroid / 11025 + pitch_std / 11025 + 1 - zcr_mean) / 4)))) + 1e-9, 6) AS quality FROM feats", SIGNAL, _FEATURES)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    snr = 2 * sc.amplitude_db(c("pitch_mean") / c("pitch_std")) / 2
    spectral = sc.spectral_quality(c("centroid"), c("centroid"), c("pitch_std"), c("zcr_mean"), 22050.0)
    rows = features(spark, sf_dir).select("rec_id", sc.quality(snr, c("energy_std") / 20, c("zcr_mean") > 0.2, c("pitch_present") > 0.5, spectral).alias("quality"))
    return round_all(rows, "quality")


@query("SELECT rec_id, round((1 - least(100 * energy_std / 10, 1) + 1 - least(100 * zcr_mean / 50, 1) + least(pitch_std / 20, 1)) / 3 + 1e-9, 6) AS voice_index, round(0.4 * least(tempo / 140, 1) + 0.3 * least(energy_mean / 0.2, 1) + 0.3 * (0.7 * pitch_present + 0.3 * least(zcr_mean * 10 / 2, 1)) + 1e-9, 6) AS danceability, round(least((pitch_std / pitch_mean + zcr_mean + pitch_present) / 3, 1) + 1e-9, 6) AS complexity FROM feats", SIGNAL, _FEATURES)
def music_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    dance = sc.danceability(c("tempo"), c("energy_mean"), sc.rhythm_score(c("pitch_present"), c("zcr_mean") * 10))
    rows = features(spark, sf_dir).select("rec_id", sc.voice_index(c("energy_std") / 10, c("zcr_mean") / 50, c("pitch_std")).alias("voice_index"), dance.alias("danceability"), sc.complexity(c("pitch_std") / c("pitch_mean"), c("zcr_mean"), c("pitch_present")).alias("complexity"))
    return round_all(rows, "voice_index danceability complexity")


_VOCAL = """vocals AS (SELECT *, (1 / (1 + pitch_std / pitch_mean) + CASE WHEN centroid BETWEEN 1000 AND 3000 THEN 1.0 WHEN centroid BETWEEN 800 AND 4000 THEN 0.7 ELSE 0.3 END + CASE WHEN zcr_mean BETWEEN 0.1 AND 0.3 THEN 1.0 WHEN zcr_mean BETWEEN 0.05 AND 0.4 THEN 0.7 ELSE 0.3 END
  + CASE WHEN -pitch_std BETWEEN -20 AND 0 AND zcr_mean BETWEEN -10 AND 10 THEN 0.8 WHEN -pitch_std BETWEEN -30 AND 10 AND zcr_mean BETWEEN -20 AND 20 THEN 0.6 ELSE 0.5 END) / 4 AS vocal FROM feats)"""


@query(f"SELECT rec_id, {rounded('vocal')} FROM vocals", SIGNAL, _FEATURES, _VOCAL)
def vocal_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(_vocals(spark, sf_dir).select("rec_id", "vocal"), "vocal")


def _vocals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return features(spark, sf_dir).withColumn("vocal", sc.vocal_fraction(1 / (1 + c("pitch_std") / c("pitch_mean")), c("centroid"), c("zcr_mean"), -c("pitch_std"), c("zcr_mean")))


@query(
    """, p AS (SELECT rec_id, unnest([{'label': 'vocal', 's': vocal}, {'label': 'drums', 's': zcr_mean * least(tempo / 120, 1) * 0.8e0}, {'label': 'bass', 's': energy_mean * 0.7e0}, {'label': 'guitar', 's': pitch_present * (1 - zcr_mean) * 0.6e0},
      {'label': 'piano', 's': energy_std * (1 - zcr_mean) * 0.5e0}, {'label': 'brass', 's': zcr_mean * (centroid / 11025) * 0.4e0}, {'label': 'strings', 's': pitch_present * (1 / (1 + pitch_std / pitch_mean)) * 0.5e0}]) AS e FROM vocals)
    SELECT rec_id, e.label AS label, round(e.s / sum(e.s) OVER (PARTITION BY rec_id) + 1e-9, 6) AS share FROM p""",
    SIGNAL, _FEATURES, _VOCAL,
)
def instrument_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    made = sc.instruments(c("vocal"), c("zcr_mean"), 1 - c("zcr_mean"), c("tempo"), c("energy_mean"), c("pitch_present"), c("zcr_mean"), c("energy_std"), c("centroid") / 11025, 1 / (1 + c("pitch_std") / c("pitch_mean")))
    rows = _vocals(spark, sf_dir).select("rec_id", F.inline(made))
    return round_all(rows.select("rec_id", "label", F.col("score").alias("share")), "share")


@query("SELECT rec_id, round(CASE WHEN centroid > 0 THEN pitch_std / centroid ELSE 0 END + 1e-9, 6) AS bandwidth_ratio, round(10 * log10(greatest(energy_mean, 1e-10) / 0.5) + 1e-9, 6) AS db, round(10 * log10(energy_mean + 1e-10) + 1e-9, 6) AS db_plain FROM feats", SIGNAL, _FEATURES)
def ratios_and_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = features(spark, sf_dir).select("rec_id", sc.ratio(c("pitch_std"), c("centroid")).alias("bandwidth_ratio"), sc.power_to_db(c("energy_mean"), F.lit(0.5), 80.0).alias("db"), sc.power_to_db(c("energy_mean")).alias("db_plain"))
    return round_all(rows, "bandwidth_ratio db db_plain")


_SIDES = "onsets AS (SELECT rec_id, frame, t FROM signal WHERE x > 40), beats AS (SELECT rec_id, t AS b, lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS before FROM signal WHERE voiced)"


def _onsets_beats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = signals.events_signal(spark, sf_dir)
    return s.where("x > 40").select("rec_id", "frame", "t"), s.where("voiced").select("rec_id", "t")


@query("SELECT o.rec_id, o.frame, round(min(abs(o.t - b.b)) + 1e-9, 6) AS distance FROM onsets o JOIN beats b ON o.rec_id = b.rec_id GROUP BY o.rec_id, o.frame, o.t", SIGNAL, _SIDES)
def nearest_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets, beats = _onsets_beats(spark, sf_dir)
    near = joins.nearest(onsets, beats).where("nearest IS NOT NULL")
    return round_all(near.select("rec_id", "frame", F.abs(F.col("t") - F.col("nearest")).alias("distance")), "distance")


@query("SELECT o.rec_id, o.frame, round(b.b + 1e-9, 6) AS previous FROM onsets o ASOF LEFT JOIN beats b ON o.rec_id = b.rec_id AND o.t >= b.b", SIGNAL, _SIDES)
def asof_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets, beats = _onsets_beats(spark, sf_dir)
    return round_all(joins.nearest(onsets, beats).select("rec_id", "frame", "previous"), "previous")


@query("SELECT rec_id, off, n, round(off / n + 1e-9, 6) AS share FROM (SELECT d.rec_id, count(*) FILTER (d > 0.1 * m) AS off, count(*) AS n FROM (SELECT o.rec_id, o.frame, min(abs(o.t - b.b)) AS d FROM onsets o JOIN beats b ON o.rec_id = b.rec_id GROUP BY o.rec_id, o.frame) d JOIN (SELECT rec_id, avg(b - before) AS m FROM beats GROUP BY rec_id) m ON d.rec_id = m.rec_id GROUP BY d.rec_id)", SIGNAL, _SIDES)
def syncopation(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets, beats = _onsets_beats(spark, sf_dir)
    return round_all(joins.syncopation(onsets, beats), "share")


@query("SELECT rec_id, count(*) FILTER (coalesce(d > gap / 4, false)) AS off_beat, count(*) AS n FROM (SELECT o.rec_id, o.frame, min(abs(o.t - b.b)) AS d, arg_min({'g': b.b - b.before}, (abs(o.t - b.b), b.b)).g AS gap FROM onsets o JOIN beats b ON o.rec_id = b.rec_id GROUP BY o.rec_id, o.frame) GROUP BY rec_id", SIGNAL, _SIDES)
def off_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets, beats = _onsets_beats(spark, sf_dir)
    return joins.off_beat(onsets, beats).groupBy("rec_id").agg(F.count_if("half").alias("off_beat"), F.count("*").alias("n"))


_FOLDED = "folded AS (SELECT vec_id, i, (SELECT sum(CAST(embedding[k] AS DOUBLE)) FROM (SELECT unnest(range(1, 65)) AS k) WHERE (k - 1) % 12 = i) AS v FROM embeddings, (SELECT unnest(range(0, 12)) AS i))"


def _templates(name: str, rows: list[tuple[int, str, list[float]]]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, '{n}', {i}, {v}e0)" for r, n, t in rows for i, v in enumerate(t)) + ") AS v(rank, name, i, w))"


def _best(table: str) -> str:
    return f"SELECT vec_id, r.name AS name, round(r.r + 1e-9, 6) AS r FROM (SELECT vec_id, max({{'r': round(r, 9), 'rank': -rank, 'name': name}}) AS r FROM (SELECT vec_id, rank, name, coalesce(corr(v, w), 0) AS r FROM folded JOIN {table} USING (i) GROUP BY vec_id, rank, name) GROUP BY vec_id)"


@query(_best("keys"), _FOLDED, _templates("keys", joins.key_templates()))
def key_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, joins.key_templates())


@query(_best("chords"), _FOLDED, _templates("chords", joins.chord_templates()))
def chord_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, joins.chord_templates())


def _match(spark: SparkSession, sf_dir: str, templates: list) -> DataFrame:
    x = joins.fold(F.col("embedding"))
    rows = signals.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).select("vec_id", joins.best_template(F.transform(joins.template_scores(F.col("x"), templates), lambda s: F.struct(F.round(s["r"], 9).alias("r"), s["rank"].alias("rank"), s["name"].alias("name")))).alias("b"))
    return round_all(rows.select("vec_id", F.col("b.name").alias("name"), F.col("b.r").alias("r")), "r")


@query("SELECT e.event_id, coalesce(c.c_name, 'none') AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = signals.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return joins.lookup(signals.table(spark, sf_dir, "events").select("event_id", "user_id"), customers, ["user_id"], {"name": "none"}).select("event_id", "name")


@query("SELECT DISTINCT rec_id FROM signal WHERE voiced", SIGNAL)
def has_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.events_signal(spark, sf_dir)
    return s.select("rec_id").distinct().join(s.where("voiced"), "rec_id", "left_semi")
