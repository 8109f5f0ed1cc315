"""Sliding segments of recordings, which samples they hold, and aggregates of these.

Segment k covers [k * hop, k * hop + length). As the hop is fixed, the segments of a sample follow from its time
by arithmetic; a join on time ranges, quadratic within a recording, isn't needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-6


@dataclass(frozen=True)
class SegmentConfig:
    """Defaults are those for audio in seconds; EVENTS below suits events in days."""

    segment_len: float = 3.0
    hop: float = 1.5
    max_seq_len: int = 128
    k_start: int = 16
    k_end: int = 16
    rms_weight: float = 0.6
    voiced_weight: float = 0.4
    pca_dims: dict[str, int] = field(default_factory=lambda: {"clap": 128, "wav2vec": 64, "yamnet": 128})
    asr_confidence: float = 0.3
    n_mels: int = 64
    n_mfcc: int = 13

    def merged(self, **changes: object) -> SegmentConfig:
        """With the known ones of the changes."""
        return replace(self, **{k: v for k, v in changes.items() if k in self.__dataclass_fields__})


EVENTS = SegmentConfig(max_seq_len=12, k_start=3, k_end=3)


def count_of(duration: Column, length: float, hop: float, tail: str = "drop") -> Column:
    """How many segments a recording has. tail: "keep" counts a shorter last one for what the full ones leave."""
    full = F.floor((duration - length + TINY) / hop) + 1
    n = F.when(duration < length, 1).otherwise(full)
    if tail == "keep":
        n = n + F.when((duration > length) & ((n - 1) * hop + length < duration - TINY), 1).otherwise(0)
    return n.cast("long")


def make_segments(recordings: DataFrame, length: float = 3.0, hop: float = 1.5, tail: str = "drop", rec: str = "rec_id") -> DataFrame:
    """rec, segment_index, start, end, duration for recordings (rec, duration); those without a positive duration have none."""
    if length <= 0 or hop <= 0:
        raise ValueError("length and hop must be positive")
    some = recordings.where("duration > 0").withColumn("_n", count_of(F.col("duration"), length, hop, tail))
    rows = some.select(rec, F.col("duration").alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("segment_index"))
    start = F.col("segment_index") * F.lit(float(hop))
    rows = rows.withColumn("start", start).withColumn("end", F.least(F.col("start") + length, "_d"))
    return rows.select(rec, "segment_index", "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def validate(segments: DataFrame, durations: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Per recording: valid (no negative start, start before end, end within the duration) and how many overlap the next."""
    w = Window.partitionBy(rec).orderBy("start")
    seen = segments.withColumn("_next", F.lead("start").over(w)).join(durations.select(rec, F.col("duration").alias("_d")), rec)
    good = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_d") + TINY)
    return seen.groupBy(rec).agg(F.bool_and(good).alias("valid"), F.count_if(F.col("_next") < F.col("end")).alias("overlaps"), F.count("*").alias("n"))


def durations(signal: DataFrame, rec: str = "rec_id", t: str = "t") -> DataFrame:
    return signal.groupBy(rec).agg(F.max(t).alias("duration"))


def assign(signal: DataFrame, recordings: DataFrame, length: float = 3.0, hop: float = 1.5, rec: str = "rec_id", t: str = "t") -> DataFrame:
    """signal rows with the segment_index of every segment that holds them: at most ceil(length / hop) each."""
    sized = signal.join(recordings.select(rec, F.col("duration").alias("_d")), rec).where("_d > 0").withColumn("_n", count_of(F.col("_d"), length, hop))
    low = F.greatest(F.lit(0), F.floor((F.col(t) - F.lit(length)) / hop))
    high = F.least(F.col("_n") - 1, F.floor(F.col(t) / hop))
    rows = sized.withColumn("segment_index", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    start = F.col("segment_index") * F.lit(float(hop))
    return rows.where((F.col(t) >= start) & (F.col(t) < F.least(start + length, "_d"))).drop("_d", "_n")


def aggregate_segments(signal: DataFrame, length: float = 3.0, hop: float = 1.5, rec: str = "rec_id") -> DataFrame:
    """Every segment with the statistics of its samples: null (fraction and counts: 0) for segments without any."""
    recordings = durations(signal, rec)
    held = assign(signal, recordings, length, hop, rec)
    stats = held.groupBy(rec, "segment_index").agg(
        F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.stddev_pop("x").alias("x_std"), F.max("x").alias("x_max"), F.min("x").alias("x_min"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg(F.col("voiced").cast("int")).alias("voiced_fraction"),
    )
    out = make_segments(recordings, length, hop, rec=rec).join(stats, [rec, "segment_index"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "voiced_fraction": F.coalesce("voiced_fraction", F.lit(0.0))})


def count_events(segments: DataFrame, events: DataFrame, length: float = 3.0, hop: float = 1.5, rec: str = "rec_id") -> DataFrame:
    """Segments with events_count and events_per_unit of events (rec, t) that begin in them, 0 where there is none."""
    recordings = segments.groupBy(rec).agg(F.max("end").alias("duration"), F.max("segment_index").alias("_last"))
    low = F.greatest(F.lit(0), F.floor((F.col("t") - F.lit(length)) / hop))
    high = F.least(F.col("_last"), F.floor(F.col("t") / hop))
    met = events.join(recordings, rec).select(rec, "t", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("segment_index"))
    inside = met.join(segments.select(rec, "segment_index", "start", "end"), [rec, "segment_index"]).where("t >= start AND t < end")
    counts = inside.groupBy(rec, "segment_index").agg(F.count("*").alias("_c"))
    out = segments.join(counts, [rec, "segment_index"], "left").withColumn("events_count", F.coalesce("_c", F.lit(0))).drop("_c")
    return out.withColumn("events_per_unit", F.when(F.col("duration") > 0, F.col("events_count") / F.col("duration")).otherwise(0.0))


def slice_arrays(segments: DataFrame, arrays: DataFrame, hop: int = 512, sr: int = 22050, rec: str = "rec_id") -> DataFrame:
    """Segments with the elements of an array per recording (rec, x) whose time, index * hop / sr, falls in them; null if none does."""
    at = F.lit(hop / sr)
    first, last = F.ceil(F.col("start") / at).cast("int"), F.ceil(F.col("end") / at).cast("int")
    part = F.slice("x", first + 1, F.greatest(F.least(last, F.size("x")) - first, F.lit(0)))
    return segments.join(arrays, rec, "left").withColumn("x", F.when(F.size(part) > 0, part))


def coverage(segments: DataFrame, durations_: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Number of segments, sum of their durations, and its ratio to the recording's."""
    total = segments.groupBy(rec).agg(F.count("*").alias("segments"), F.sum("duration").alias("covered"))
    return total.join(durations_.select(rec, F.col("duration").alias("_d")), rec).select(rec, "segments", "covered", F.when(F.col("_d") > 0, F.col("covered") / F.col("_d")).otherwise(0.0).alias("ratio"))


def frame_times(recordings: DataFrame, hop: int = 512, sr: int = 22050, rec: str = "rec_id") -> DataFrame:
    """rec, frame, t for int(duration * sr / hop) frames."""
    n = F.floor(F.col("duration") * sr / hop).cast("long")
    rows = recordings.withColumn("_n", n).where("_n > 0").select(rec, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("frame"))
    return rows.withColumn("t", F.col("frame") * hop / F.lit(float(sr)))


def fixed_windows(recordings: DataFrame, length: float, hop: float, rec: str = "rec_id") -> DataFrame:
    """Windows that begin before duration - length, and so never end exactly at the end."""
    n = F.ceil((F.col("duration") - length) / hop).cast("long")
    rows = recordings.withColumn("_n", n).where("_n > 0").select(rec, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("window"))
    return rows.withColumn("start", F.col("window") * F.lit(float(hop))).withColumn("end", F.col("start") + length)
