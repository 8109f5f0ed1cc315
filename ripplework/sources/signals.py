"""Signals as rows: rec_id, frame, t (days for events, seconds for audio), x and, where known, voiced."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplework.functions.binding import let
from ripplework.operators import dsp
from ripplework.session import bound_batches

AUDIO_EXTENSIONS = (".wav", ".mp3", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".aiff", ".au")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv")
VOICED_TYPES = ("view", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """A recording for each user, in order of (ts, event_id); t in days since its first event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id")
    return events.select(
        F.col("user_id").alias("rec_id"),
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("frame"),
        ((micros - F.min(micros).over(own)) / F.lit(86400000000.0)).alias("t"),
        F.col("value").alias("x"), "event_type", F.col("event_type").isin(*VOICED_TYPES).alias("voiced"),
    )


def events_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def intervals_from_turns(conversations: DataFrame) -> DataFrame:
    """A timeline of speakers: each turn begins where the ones before it end, and lasts as long as its text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    return conversations.select(F.col("conv_id").alias("rec_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), start.alias("start"), (start + size).alias("end"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """Long form of vectors: rec_id (vec_id), label, pos, v."""
    return embeddings.select(F.col("vec_id").alias("rec_id"), "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def to_mono(channels: Column) -> Column:
    """Mean over an array of equally long channel arrays."""
    return let(channels, lambda ch: F.when(F.size(ch) == 1, ch[0]).otherwise(F.transform(F.sequence(F.lit(0), F.size(ch[0]) - 1), lambda i: F.aggregate(ch, F.lit(0.0), lambda a, c: a + c[i]) / F.size(ch))))


def has_shape(channels: Column, n: int) -> Column:
    """Whether an array of channels is n arrays of one length."""
    return (F.size(channels) == n) & (F.size(F.array_distinct(F.transform(channels, F.size))) == 1)


def fit_length(x: Column, n: int) -> Column:
    """Cropped, or padded with zeros, to n samples."""
    return F.concat(F.slice(x, 1, n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(x), F.lit(0)).cast("int")))


def valid_media(path: Column, length: Column, extensions: tuple[str, ...] = AUDIO_EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]+$", 0)).isin(*extensions) & (length > 0)


def valid_uri(uri: Column) -> Column:
    return (uri != "") & (uri.startswith("s3://") | uri.startswith("/") | F.lower(uri).rlike(r"\.(wav|mp3|flac)$"))


def parse_s3(uri: Column) -> tuple[Column, Column]:
    """Bucket and key."""
    return F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 1), F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 2)


def pcm(raw: bytes, width: int) -> np.ndarray:
    """Samples of 1 (unsigned), 2, 3 or 4 bytes, little-endian, between -1 and 1."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return wide.reshape(-1).view("<i4") / 2.0**31
    return np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)


def _decode(frame: pd.DataFrame, sr: int | None) -> pd.DataFrame:
    rows = []
    for path, content in zip(frame["path"], frame["content"], strict=True):
        try:
            with wave.open(io.BytesIO(content)) as f:
                width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
                x = pcm(f.readframes(f.getnframes()), width).reshape(-1, channels)
            rows.append((path, sr or own, [(dsp.resampled(c, own, sr) if sr else c).tolist() for c in x.T], None))
        except Exception as e:  # noqa: BLE001  one bad file is one failed row
            rows.append((path, None, None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=["path", "sr", "channels", "error"])


def read_wav(spark: SparkSession, path: str, sr: int | None = 22050) -> DataFrame:
    """path, sr, channels (array of arrays) of WAV files, resampled to sr or, where that is None, at their own rates; error says why a file couldn't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return decoded(files, sr)


def decoded(files: DataFrame, sr: int | None = 22050) -> DataFrame:
    """The same of files that are rows (path, content)."""
    bound_batches(files.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield _decode(frame, sr)

    return files.select("path", "content").mapInPandas(decode, "path string, sr int, channels array<array<double>>, error string")


def samples(waves: DataFrame, rec: str = "path") -> DataFrame:
    """Peak-normalised mono samples in long form: rec_id, sr, frame, t (seconds), x."""
    mono = waves.where("error IS NULL").select(F.col(rec).alias("rec_id"), "sr", to_mono(F.col("channels")).alias("y"))
    scaled = let(F.col("y"), lambda y: let(F.greatest(F.array_max(y), -F.array_min(y), F.lit(1e-8)), lambda peak: F.transform(y, lambda v: v / peak)))
    return mono.select("rec_id", "sr", F.posexplode(scaled).alias("frame", "x")).select("rec_id", "sr", "frame", (F.col("frame") / F.col("sr")).alias("t"), "x")


def synthetic(spark: SparkSession, kind: str = "sine", freq: float = 440.0, seconds: float = 1.0, sr: int = 22050) -> DataFrame:
    """sr, x: sine, chirp (to five times freq), silence, clipped or noise, made by Spark."""
    t = F.col("frame") / F.lit(float(sr))
    wave_of = {
        "sine": F.sin(2 * np.pi * freq * t), "silence": F.lit(0.0), "noise": F.randn(42) * 0.2,
        "chirp": F.sin(2 * np.pi * (freq * t + (5 * freq - freq) / (2 * seconds) * t * t)),
        "clipped": F.greatest(F.least(1.5 * F.sin(2 * np.pi * freq * t), F.lit(0.8)), F.lit(-0.8)),
    }
    return spark.range(int(seconds * sr)).select(F.lit(kind).alias("rec_id"), F.col("id").alias("frame")).select("rec_id", "frame", t.alias("t"), wave_of[kind].alias("x"))


def windows_of_samples(samples_: DataFrame, size: int) -> DataFrame:
    """Long samples as one array a recording, cut to `size` where it is given; with the rate, where samples have theirs."""
    rate = [c for c in ("sr",) if c in samples_.columns]
    arrays = samples_.groupBy("rec_id", *rate).agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("a"))
    x = F.transform("a", lambda s: s["x"])
    return arrays.select("rec_id", *rate, (fit_length(x, size) if size else x).alias("x"))
