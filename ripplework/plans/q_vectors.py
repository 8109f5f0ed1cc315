"""Queries for vectors and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.operators import embedding as em
from ripplework.operators import spectral as sp
from ripplework.plans.registry import SIGNAL, VECTORS, query, round_all, rounded
from ripplework.sources import signals


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "embeddings")


@query("SELECT rec_id, pos, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END + 1e-9, 5) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY pos) AS m, stddev_pop(v) OVER (PARTITION BY pos) AS s FROM vectors)", VECTORS)
def zscore_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(em.zscores(signals.vectors(_embeddings(spark, sf_dir))).select("rec_id", "pos", "z"), "z", 5)


@query("SELECT label, pos, round(avg(v) + 1e-9, 6) AS v FROM vectors GROUP BY label, pos", VECTORS)
def time_mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(em.time_mean(_embeddings(spark, sf_dir), "label"), "v")


@query()
def pca_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumn("kind", F.lit("clap"))
    made = em.Compressor({"clap": 8, "absent": 4}).fit(rows).transform(rows)
    return made.select("vec_id", F.posexplode("pca").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) + 1e-9, 5) AS total FROM embeddings")
def float_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return round_all(_embeddings(spark, sf_dir).select("vec_id", F.size("embedding").alias("dim"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("total")), "total", 5)


_FRAMED = "framed AS (SELECT s.rec_id, w AS frame, s.frame - w * 8 AS k, x FROM signal s JOIN (SELECT rec_id, unnest(range(0, (max(frame) + 1 - 16) // 8 + 1)) AS w FROM signal GROUP BY rec_id) f ON s.rec_id = f.rec_id AND s.frame >= w * 8 AND s.frame < w * 8 + 16)"
_SPECTRA = f"{_FRAMED}, spectra AS (SELECT rec_id, frame, bin, bin * 10e0 AS freq, sqrt(pow(sum(x * cos(2 * pi() / 16 * ((k * bin) % 16))), 2) + pow(sum(x * sin(2 * pi() / 16 * ((k * bin) % 16))), 2)) AS mag FROM framed, (SELECT unnest(range(0, 9)) AS bin) GROUP BY rec_id, frame, bin)"
_DESCRIBED = f"""{_SPECTRA}, m AS (SELECT *, sum(mag) OVER f AS total, sum(freq * mag) OVER f / sum(mag) OVER f AS c, sum(mag) OVER (PARTITION BY rec_id, frame ORDER BY bin) AS cum FROM spectra WINDOW f AS (PARTITION BY rec_id, frame)),
described AS (SELECT rec_id, frame, max(c) AS centroid, sqrt(sum(pow(freq - c, 2) * mag) / max(total)) AS bandwidth, exp(avg(ln(greatest(mag, 1e-10)))) / avg(greatest(mag, 1e-10)) AS flatness,
  -sum(mag / total * log2(mag / total + 1e-10)) AS entropy, sum(mag * mag) AS energy, min(freq) FILTER (cum >= 0.85 * total) AS rolloff FROM m GROUP BY rec_id, frame)"""


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.dft(sp.frames(signals.events_signal(spark, sf_dir), 16, 8), 16, 160.0)


@query(f"SELECT rec_id, frame, bin, {rounded('mag', 4)} FROM spectra", SIGNAL, _SPECTRA)
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(_spectra(spark, sf_dir).select("rec_id", "frame", "bin", "mag"), "mag", 4)


@query(f"SELECT rec_id, frame, {rounded('centroid bandwidth flatness entropy', 5)} FROM described", SIGNAL, _DESCRIBED)
def centroid_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.descriptors(_spectra(spark, sf_dir)).select("rec_id", "frame", "centroid", "bandwidth", "flatness", "entropy"), "centroid bandwidth flatness entropy", 5)


@query("SELECT rec_id, frame, rolloff FROM described", SIGNAL, _DESCRIBED)
def rolloff85(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.descriptors(_spectra(spark, sf_dir)).select("rec_id", "frame", "rolloff")


@query("SELECT rec_id, frame, round(sum(pow(mag - p, 2)) + 1e-9, 3) AS flux FROM (SELECT *, lag(mag) OVER (PARTITION BY rec_id, bin ORDER BY frame) AS p FROM spectra) GROUP BY rec_id, frame", SIGNAL, _SPECTRA)
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.flux(_spectra(spark, sf_dir)), "flux", 3)


@query(f"SELECT rec_id, frame, {rounded('irregularity decrease slope', 4)} FROM (SELECT rec_id, frame, avg(abs(d)) AS irregularity, avg(d) AS decrease, regr_slope(l, freq) AS slope FROM (SELECT *, mag - lag(mag) OVER (PARTITION BY rec_id, frame ORDER BY bin) AS d, ln(greatest(mag, 1e-10)) AS l FROM spectra) GROUP BY rec_id, frame)", SIGNAL, _SPECTRA)
def spectral_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.irregularity(_spectra(spark, sf_dir)), "irregularity decrease slope", 4)


@query("SELECT rec_id, frame, band, round(max(mag) - min(mag) + 1e-9, 4) AS contrast FROM (SELECT *, CAST(least(bin // 1, 5) AS INTEGER) AS band FROM spectra) GROUP BY rec_id, frame, band", SIGNAL, _SPECTRA)
def spectral_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.contrast(_spectra(spark, sf_dir)), "contrast", 4)


@query(f"SELECT rec_id, {rounded('low mid high')} FROM (SELECT rec_id, sum(CASE WHEN freq <= 20 THEN mag * mag ELSE 0 END) / (sum(mag * mag) + 1e-10) AS low, sum(CASE WHEN freq > 20 AND freq < 60 THEN mag * mag ELSE 0 END) / (sum(mag * mag) + 1e-10) AS mid, sum(CASE WHEN freq >= 60 THEN mag * mag ELSE 0 END) / (sum(mag * mag) + 1e-10) AS high FROM spectra GROUP BY rec_id)", SIGNAL, _SPECTRA)
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.band_shares(_spectra(spark, sf_dir), 20.0, 60.0), "low mid high")


@query(
    """, e AS (SELECT rec_id, frame, sum(mag * mag) AS e FROM spectra GROUP BY rec_id, frame), p AS (SELECT rec_id, quantile_cont(e, 0.1) AS p FROM e GROUP BY rec_id),
    b AS (SELECT s.rec_id, bin, e.e <= p.p AS noise, avg(mag) AS m FROM spectra s JOIN e ON s.rec_id = e.rec_id AND s.frame = e.frame JOIN p ON s.rec_id = p.rec_id GROUP BY s.rec_id, bin, e.e <= p.p)
    SELECT rec_id, round(CASE WHEN n > 0 AND t > 0 THEN 10 * log10(t / n) WHEN t > 0 THEN 100 ELSE 0 END + 1e-9, 5) AS snr_db FROM (SELECT rec_id, sum(m * m) FILTER (noise) AS n, sum(m * m) FILTER (NOT noise) AS t FROM b GROUP BY rec_id)""",
    SIGNAL, _SPECTRA,
)
def spectral_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.spectral_snr(_spectra(spark, sf_dir)), "snr_db", 5)


@query("SELECT rec_id, round(avg(CASE WHEN s <> ps THEN 1e0 WHEN ps IS NOT NULL THEN 0 END) + 1e-9, 6) AS zcr, round(avg(CASE WHEN d <> pd THEN 1e0 WHEN pd IS NOT NULL THEN 0 END) + 1e-9, 6) AS turning_rate FROM (SELECT *, lag(s) OVER (PARTITION BY rec_id ORDER BY frame) AS ps, lag(d) OVER (PARTITION BY rec_id ORDER BY frame) AS pd FROM (SELECT rec_id, frame, CASE WHEN x < 50 THEN -1 ELSE 1 END AS s, sign((x - 50) - lag(x - 50) OVER (PARTITION BY rec_id ORDER BY frame)) AS d FROM signal)) GROUP BY rec_id", SIGNAL)
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.events_signal(spark, sf_dir).withColumn("x", F.col("x") - 50)
    return round_all(sp.zero_crossings(s), "zcr turning_rate")


@query("SELECT rec_id, CAST(frame / 4 AS BIGINT) AS frame, round(sqrt(e / 8) + 1e-9, 6) AS rms FROM (SELECT *, sum(x * x) OVER (PARTITION BY rec_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS e FROM signal) WHERE frame % 4 = 0", SIGNAL)
def rms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.rms_frames(signals.events_signal(spark, sf_dir), 8, 4), "rms")


@query("SELECT rec_id, CAST(w AS BIGINT) AS frame, round(rms + 1e-9, 6) AS rms, rms > 0.5 * max(rms) OVER (PARTITION BY rec_id) AS voiced FROM (SELECT rec_id, frame // 5 AS w, sqrt(avg(x * x)) AS rms FROM signal GROUP BY ALL HAVING count(*) = 5)", SIGNAL)
def voice_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sp.voice_activity(signals.events_signal(spark, sf_dir), 5, 0.5), "rms")
