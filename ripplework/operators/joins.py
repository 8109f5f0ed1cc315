"""Joins that the engine adds to Spark's: nearest and preceding match, template match, registry lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, rec: str = "rec_id", t: str = "t") -> DataFrame:
    """left rows with nearest and previous: the time of right's nearest row (the earlier one among equals) and of its last row at or before it.

    Both sides are sorted together once: a row's neighbours are the last and next right row, so the work is
    linear in the rows instead of their product.
    """
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.select(rec, F.col(t)).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    own = F.when(F.col("_side") == 0, F.col(t))
    w = Window.partitionBy(rec).orderBy(t, "_side")
    back = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = sides.withColumn("previous", back).withColumn("_next", ahead).where("_side = 1")
    near = F.when(F.col("_next").isNull() | (F.col(t) - F.col("previous") <= F.col("_next") - F.col(t)), F.col("previous")).otherwise(F.col("_next"))
    return seen.withColumn("nearest", near).drop("_side", "_next")


def syncopation(onsets: DataFrame, beats: DataFrame, tolerance: float = 0.1, rec: str = "rec_id") -> DataFrame:
    """Onsets further from the nearest beat than `tolerance` times the mean beat interval: count and share."""
    w = Window.partitionBy(rec).orderBy("t")
    mean = beats.withColumn("_gap", F.col("t") - F.lag("t").over(w)).groupBy(rec).agg(F.avg("_gap").alias("_mean"))
    met = nearest(onsets, beats, rec).join(mean, rec)
    off = F.abs(F.col("t") - F.col("nearest")) > tolerance * F.col("_mean")
    return met.groupBy(rec).agg(F.count_if(off).alias("off"), F.count("*").alias("n")).withColumn("share", F.col("off") / F.col("n"))


def off_beat(onsets: DataFrame, beats: DataFrame, rec: str = "rec_id") -> DataFrame:
    """half: whether an onset is over a quarter of the interval, from the beat before its nearest one to that, away from it."""
    w = Window.partitionBy(rec).orderBy("t")
    gaps = beats.select(rec, F.col("t").alias("nearest"), (F.col("t") - F.lag("t").over(w)).alias("interval"))
    return nearest(onsets, beats, rec).join(gaps, [rec, "nearest"], "left").withColumn("half", F.coalesce(F.abs(F.col("t") - F.col("nearest")) > F.col("interval") / 4, F.lit(False)))


def lookup(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left outer, with defaults where nothing matches."""
    return left.join(right, on, "left").fillna(defaults)


def unknown(requested: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    return requested.join(known.select(name), name, "left_anti")


# Pitch classes, key profiles, chord templates.
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
CHORDS = {
    "C": (1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0),
    "Cm": (1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0),
    "C7": (1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 1, 0),
    "Cmaj7": (1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1),
    "Cm7": (1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0),
}


def key_templates() -> list[tuple[int, str, list[float]]]:
    """rank, name, profile: each key's major and minor profile is that of C turned to its root."""
    out = []
    for i, key in enumerate(KEYS):
        for suffix, profile in (("", MAJOR), ("m", MINOR)):
            out.append((len(out), f"{key}{suffix}", [float(profile[(j - i) % 12]) for j in range(12)]))
    return out


def chord_templates() -> list[tuple[int, str, list[float]]]:
    return [(i, name, [float(v) for v in t]) for i, (name, t) in enumerate(CHORDS.items())]


def template_scores(x: Column, templates: list[tuple[int, str, list[float]]]) -> Column:
    """Array of (r, rank, name): the correlation of an array with each template, 0 where it is undefined. A row at a time: nothing is joined."""
    n = len(templates[0][2])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    rows = []
    for rank, name, t in templates:
        m = sum(t) / n
        c = [v - m for v in t]
        size = sum(v * v for v in c) ** 0.5
        lit = F.array(*[F.lit(v) for v in c])
        dot = F.aggregate(F.zip_with(x, lit, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        rows.append(F.struct(dot.alias("dot"), F.lit(size).alias("size"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")))
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) - n * mean(x) * mean(x))
    return F.transform(F.array(*rows), lambda r: F.struct(F.coalesce(F.nanvl(F.when(spread > 0, r["dot"] / (spread * r["size"])), F.lit(0.0)), F.lit(0.0)).alias("r"), r["rank"].alias("rank"), r["name"].alias("name")))


def best_template(scores: Column) -> Column:
    """The best score, the first template among equals."""
    return F.array_max(scores)


def fold(x: Column, n: int = 12) -> Column:
    """Sums of every n-th element, from each of the first n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.filter(x, lambda v, k: k % n == i), F.lit(0.0), lambda s, v: s + v.cast("double")))
