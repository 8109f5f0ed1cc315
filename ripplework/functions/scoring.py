"""Rule-based scores. Rules are data: a condition in SQL and the points it gives; both engines read the same text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conditions and points of sound events.
EVENTS = {
    "speech": (("pitch_present > 0.5", 0.4), ("energy_mean BETWEEN 0.05 AND 0.2", 0.3), ("zcr_mean BETWEEN 0.1 AND 0.3", 0.3)),
    "music": (("pitch_present > 0.5", 0.3), ("energy_mean > 0.1", 0.3), ("zcr_mean < 0.2", 0.4)),
    "noise": (("pitch_present < 0.3", 0.4), ("zcr_mean > 0.3", 0.3), ("centroid_std > 1000", 0.3)),
    "silence": (("energy_mean < 0.01", 0.5), ("pitch_present < 0.1", 0.5)),
    "environmental": (("pitch_present < 0.4", 0.3), ("energy_mean BETWEEN 0.02 AND 0.15", 0.3), ("zcr_mean BETWEEN 0.1 AND 0.4", 0.4)),
    "mechanical": (("pitch_present < 0.3", 0.3), ("energy_mean > 0.05", 0.3), ("zcr_mean > 0.2", 0.4)),
    "human": (("pitch_present > 0.4", 0.4), ("energy_mean BETWEEN 0.03 AND 0.2", 0.3), ("zcr_mean BETWEEN 0.1 AND 0.3", 0.3)),
    "alarm": (("pitch_present > 0.5", 0.3), ("energy_mean > 0.1", 0.3), ("zcr_mean < 0.2", 0.4)),
}
# Conditions and points of acoustic scenes.
SCENES = {
    "indoor": (("energy_mean < 0.1", 0.3), ("pitch_present > 0.3", 0.4), ("zcr_mean < 0.3", 0.3)),
    "outdoor": (("energy_mean > 0.05", 0.3), ("pitch_present < 0.4", 0.4), ("zcr_mean > 0.2", 0.3)),
    "transport": (("energy_mean > 0.1", 0.4), ("pitch_present < 0.3", 0.3), ("zcr_mean > 0.3", 0.3)),
    "nature": (("energy_mean BETWEEN 0.02 AND 0.1", 0.3), ("pitch_present < 0.4", 0.4), ("zcr_mean BETWEEN 0.1 AND 0.4", 0.3)),
    "urban": (("energy_mean > 0.08", 0.4), ("pitch_present < 0.4", 0.3), ("zcr_mean > 0.25", 0.3)),
    "quiet": (("energy_mean < 0.03", 0.5), ("zcr_mean < 0.2", 0.5)),
    "noisy": (("energy_mean > 0.1", 0.5), ("zcr_mean > 0.3", 0.5)),
}
# Emotions, a strong condition for 0.4 and a weak one for 0.2; neutral has 0.4 or 0.1.
EMOTIONS = {
    "happy": ("pitch_mean > 200 AND energy_mean > 0.1 AND tempo > 120", "pitch_mean > 180 AND energy_mean > 0.08"),
    "sad": ("pitch_mean < 150 AND energy_mean < 0.05 AND tempo < 80", "pitch_mean < 170 AND energy_mean < 0.07"),
    "angry": ("pitch_std > 50 AND energy_mean > 0.12 AND tempo > 100", "pitch_std > 40 AND energy_mean > 0.1"),
    "fearful": ("pitch_mean > 220 AND energy_std > 0.05 AND tempo > 110", "pitch_mean > 200 AND energy_std > 0.03"),
    "surprised": ("pitch_mean > 250 AND energy_mean > 0.15 AND tempo > 130", "pitch_mean > 230 AND energy_mean > 0.12"),
    "disgusted": ("pitch_mean < 140 AND energy_mean < 0.04 AND tempo < 70", "pitch_mean < 160 AND energy_mean < 0.06"),
}
NEUTRAL = "pitch_mean BETWEEN 150 AND 200 AND energy_mean BETWEEN 0.06 AND 0.1 AND tempo BETWEEN 80 AND 120 AND pitch_std < 30"
# Upper bounds of tempo classes; beyond the last it is extremely_fast.
TEMPO_CLASSES = ((60, "very_slow"), (80, "slow"), (100, "moderate"), (120, "medium"), (140, "fast"), (180, "very_fast"))
# Confidence of a mean word probability at least so high.
CONFIDENCE = ((0.8, 0.9), (0.6, 0.7), (0.4, 0.5))


def points(rules: tuple[tuple[str, float], ...]) -> str:
    """The sum of a label's points, 1 at most, as SQL."""
    return "least(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0.0 END" for c, p in rules) + ", 1.0)"


def event_sql(label: str) -> str:
    return f"CAST({points(EVENTS[label])} AS DOUBLE)"


def scene_sql(label: str) -> str:
    return f"CAST({points(SCENES[label])} AS DOUBLE)"


def emotion_sql(label: str) -> str:
    if label == "neutral":
        return f"CAST(CASE WHEN {NEUTRAL} THEN 0.4 ELSE 0.1 END AS DOUBLE)"
    strong, weak = EMOTIONS[label]
    return f"CAST(CASE WHEN {strong} THEN 0.4 WHEN {weak} THEN 0.2 ELSE 0.0 END AS DOUBLE)"


def scores(labels: tuple[str, ...], sql) -> Column:
    """Array of (score, rank, label); array_max gives the best, the first among equals."""
    return F.array(*[F.struct(F.expr(sql(x)).alias("score"), F.lit(-i).alias("rank"), F.lit(x).alias("label")) for i, x in enumerate(labels)])


def event_scores() -> Column:
    return scores(tuple(EVENTS), event_sql)


def best_event(found: Column) -> Column:
    best = F.array_max(found)
    return F.when(best["score"] > 0.3, best["label"]).otherwise("unknown")


def shares(found: Column) -> Column:
    """Scores as shares of their sum."""
    total = F.aggregate(found, F.lit(0.0), lambda a, s: a + s["score"])
    return F.transform(found, lambda s: F.struct(F.when(total > 0, s["score"] / total).otherwise(s["score"]).alias("score"), s["rank"].alias("rank"), s["label"].alias("label")))


def scene_scores() -> Column:
    return shares(scores(tuple(SCENES), scene_sql))


def emotion_scores() -> Column:
    return shares(scores((*EMOTIONS, "neutral"), emotion_sql))


def capped(x: Column, top: float) -> Column:
    """x / top, 1 at most."""
    return F.least(x / top, F.lit(1.0))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def valence(pitch: Column, centroid: Column) -> Column:
    return (capped(pitch, 300.0) + capped(centroid, 4000.0)) / 2


def arousal(energy: Column, tempo: Column) -> Column:
    return (capped(energy, 0.2) + capped(tempo, 200.0)) / 2


def tempo_class(bpm: Column) -> Column:
    out = F.when(bpm < TEMPO_CLASSES[0][0], TEMPO_CLASSES[0][1])
    for bound, name in TEMPO_CLASSES[1:]:
        out = out.when(bpm < bound, name)
    return out.otherwise("extremely_fast")


def confidence(p: Column) -> Column:
    out = F.when(p >= CONFIDENCE[0][0], CONFIDENCE[0][1])
    for bound, value in CONFIDENCE[1:]:
        out = out.when(p >= bound, value)
    return out.otherwise(0.3)


def rhythm_complexity(strength_cv: Column, onsets: Column, beats: Column) -> Column:
    return F.least((strength_cv + F.when(beats > 0, onsets / beats).otherwise(0.0)) / 2, F.lit(1.0))


def quality(snr_db: Column, clipped: Column, hum: Column, distorted: Column, spectral: Column) -> Column:
    free = lambda c: F.when(c, 0.0).otherwise(1.0)
    return clip(0.3 * capped(snr_db, 40.0) + 0.25 * F.greatest(F.lit(0.0), 1 - 100 * clipped) + 0.2 * free(hum) + 0.15 * free(distorted) + 0.1 * spectral)


def spectral_quality(centroid: Column, rolloff: Column, bandwidth: Column, zcr: Column, sr: float) -> Column:
    nyquist = sr / 2
    return clip((centroid / nyquist + rolloff / nyquist + bandwidth / nyquist + 1 - zcr) / 4)


def voice_index(jitter: Column, shimmer: Column, hnr: Column) -> Column:
    return (3 - F.least(100 * jitter, F.lit(1.0)) - F.least(100 * shimmer, F.lit(1.0)) - 1 + capped(hnr, 20.0)) / 3


def rhythm_score(regularity: Column, density: Column) -> Column:
    return 0.7 * regularity + 0.3 * capped(density, 2.0)


def danceability(tempo: Column, energy: Column, rhythm: Column) -> Column:
    return 0.4 * capped(tempo, 140.0) + 0.3 * capped(energy, 0.2) + 0.3 * rhythm


def complexity(*cvs: Column) -> Column:
    total = cvs[0]
    for c in cvs[1:]:
        total = total + c
    return F.least(total / len(cvs), F.lit(1.0))


def tiered(x: Column, tiers: tuple[tuple[float, float, float], ...], otherwise: float) -> Column:
    """The value of the first tier (low, high, value) that holds x."""
    out = F.when(x.between(tiers[0][0], tiers[0][1]), tiers[0][2])
    for low, high, value in tiers[1:]:
        out = out.when(x.between(low, high), value)
    return out.otherwise(otherwise)


def vocal_fraction(stability: Column, centroid: Column, zcr: Column, mfcc1: Column, mfcc2: Column) -> Column:
    """Mean of four indicators."""
    bands = F.when(mfcc1.between(-20, 0) & mfcc2.between(-10, 10), 0.8).when(mfcc1.between(-30, 10) & mfcc2.between(-20, 20), 0.6).otherwise(0.5)
    return (stability + tiered(centroid, ((1000, 3000, 1.0), (800, 4000, 0.7)), 0.3) + tiered(zcr, ((0.1, 0.3, 1.0), (0.05, 0.4, 0.7)), 0.3) + bands) / 4


def instruments(vocal: Column, percussive: Column, harmonic: Column, tempo: Column, low: Column, mid: Column, high: Column, wide: Column, brightness: Column, smoothness: Column) -> Column:
    """Shares of seven instruments."""
    parts = {
        "vocal": vocal, "drums": percussive * capped(tempo, 120.0) * 0.8, "bass": low * 0.7, "guitar": mid * harmonic * 0.6,
        "piano": wide * harmonic * 0.5, "brass": high * brightness * 0.4, "strings": mid * smoothness * 0.5,
    }
    return shares(F.array(*[F.struct(v.cast("double").alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("label")) for i, (k, v) in enumerate(parts.items())]))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def power_to_db(power: Column, ref: Column | None = None, floor_db: float | None = None) -> Column:
    """10 log10: against ref with a floor of 1e-10 (and floor_db below 0 at most), or of power + 1e-10 alone."""
    if ref is None:
        return 10 * F.log10(power + 1e-10)
    db = 10 * F.log10(F.greatest(power, F.lit(1e-10)) / F.greatest(ref, F.lit(1e-10)))
    return db if floor_db is None else F.greatest(db, F.lit(-floor_db))


def amplitude_db(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x))
