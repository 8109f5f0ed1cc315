"""Selecting, scoring, padding and flattening segments; ranks, samples and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(df: DataFrame, x: str, rec: str = "rec_id") -> Column:
    """x between 0 and 1 within its recording; 1 for all if they are equal."""
    w = Window.partitionBy(rec)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(x) - low) / (high - low))


def peak_normalise(x: str, rec: str = "rec_id") -> Column:
    return F.col(x) / F.greatest(F.max(F.abs(F.col(x))).over(Window.partitionBy(rec)), F.lit(1e-8))


def importance(df: DataFrame, rms: str = "rms", voiced: str = "voiced_fraction", weights: tuple[float, float] = (0.6, 0.4), rec: str = "rec_id") -> DataFrame:
    """score: weighted sum of both, each scaled within the recording; null counts as 0."""
    filled = df.withColumn("_rms", F.coalesce(rms, F.lit(0.0))).withColumn("_voiced", F.coalesce(voiced, F.lit(0.0)))
    return filled.withColumn("score", weights[0] * min_max(filled, "_rms", rec) + weights[1] * min_max(filled, "_voiced", rec)).drop("_rms", "_voiced")


def ranked(df: DataFrame, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """With _i (0 from the start) and _n (rows of the recording)."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(rec).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(rec)))


def boundary_importance(df: DataFrame, max_len: int, k_start: int, k_end: int, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """All of a recording of at most max_len rows; else its first k_start, its last k_end, and the best of the middle by score, earlier ones first among equals.

    Scores are scaled within the middle alone. Where the ends fill max_len, boundary_only decides.
    """
    if k_start + k_end >= max_len:
        return boundary_only(df, max_len, k_start, rec, order)
    base = ranked(df, rec, order)
    middle = base.where((F.col("_n") > max_len) & (F.col("_i") >= k_start) & (F.col("_i") < F.col("_n") - k_end))
    best = importance(middle, rec=rec).withColumn("_k", F.row_number().over(Window.partitionBy(rec).orderBy(F.desc(F.round("score", 9)), F.asc(order)))).where(F.col("_k") <= max_len - k_start - k_end)
    ends = base.where((F.col("_n") <= max_len) | (F.col("_i") < k_start) | (F.col("_i") >= F.col("_n") - k_end)).withColumn("score", F.lit(None).cast("double"))
    return ends.unionByName(best.drop("_k")).drop("_i", "_n")


def boundary_only(df: DataFrame, max_len: int, k_start: int, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """The first k_start rows and as many of the last as fill max_len; the first max_len alone if k_start reaches that."""
    base = ranked(df, rec, order)
    k = min(k_start, max_len)
    keep = (F.col("_n") <= max_len) | (F.col("_i") < k) | (F.col("_i") >= F.col("_n") - (max_len - k))
    return base.where(keep).drop("_i", "_n")


def uniform(df: DataFrame, max_len: int, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """Rows floor(j * n / max_len) for j from 0; all if there are at most max_len."""
    base = ranked(df, rec, order)
    j = F.ceil(F.col("_i") * max_len / F.col("_n"))
    return base.where((F.col("_n") <= max_len) | ((j < max_len) & (F.floor(j * F.col("_n") / max_len) == F.col("_i")))).drop("_i", "_n")


def random(df: DataFrame, max_len: int, seed: int = 42, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """max_len rows of each recording by a seeded hash: the same every time."""
    w = Window.partitionBy(rec).orderBy(F.xxhash64(rec, order, F.lit(seed)), order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_len).drop("_k")


def replace_some(df: DataFrame, share: float = 0.1, seed: int = 42, rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """source: the index that a row's features come from; a hashed share of the rows take another's of their recording, the rest their own."""
    base = ranked(df, rec, order)
    roll = F.pmod(F.xxhash64(rec, order, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    other = F.pmod(F.col("_i") + 1 + F.pmod(F.xxhash64(order, rec, F.lit(seed + 1)), F.greatest(F.col("_n") - 1, F.lit(1))), F.col("_n"))
    return base.withColumn("source", F.when(roll < share, other).otherwise(F.col("_i")).cast("long")).drop("_i", "_n")


def select(df: DataFrame, strategy: str, max_len: int, k_start: int = 16, k_end: int = 16, seed: int = 42, rec: str = "rec_id") -> DataFrame:
    """One of all, boundary_importance, random, uniform."""
    if strategy == "all":
        return df
    if strategy == "boundary_importance":
        return boundary_importance(df, max_len, k_start, k_end, rec)
    if strategy == "random":
        return random(df, max_len, seed, rec)
    if strategy == "uniform":
        return uniform(df, max_len, rec)
    raise ValueError(f"unknown strategy: {strategy}")


def padded(df: DataFrame, max_len: int, values: tuple[str, ...], rec: str = "rec_id", order: str = "segment_index") -> DataFrame:
    """pos 0 to max_len - 1 of each recording, mask 1 where there is a row, values 0 elsewhere."""
    rows = ranked(df, rec, order).where(F.col("_i") < max_len).withColumn("pos", F.col("_i").cast("long"))
    grid = df.select(rec).distinct().select(rec, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_len - 1).cast("long"))).alias("pos"))
    out = grid.join(rows.select(rec, "pos", *values, F.lit(1).alias("mask")), [rec, "pos"], "left")
    return out.select(rec, "pos", F.coalesce("mask", F.lit(0)).alias("mask"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def flatten(scalars: list[Column], embeddings: list[Column], rest: list[Column], width: int, layout: str = "compact", dims: list[int] | None = None) -> Column:
    """A row's features as one float array of `width`: scalars (null: 0), embeddings, then the rest, cut or filled with 0.

    compact: a missing array takes no room, so later ones move up. fixed: each has its place (dims) whatever is missing.
    """
    empty = F.array().cast("array<double>")
    arrays = [*embeddings, *rest]
    if layout == "fixed":
        if dims is None:
            raise ValueError("a fixed layout needs dims")
        parts = [F.slice(F.concat(F.coalesce(a.cast("array<double>"), empty), F.array_repeat(F.lit(0.0), d)), 1, d) for a, d in zip(arrays, dims, strict=True)]
    else:
        parts = [F.coalesce(a.cast("array<double>"), empty) for a in arrays]
    joined = F.concat(F.array(*[F.coalesce(s.cast("double"), F.lit(0.0)) for s in scalars]), *parts)
    return F.slice(F.concat(joined, F.array_repeat(F.lit(0.0), width)), 1, width).cast("array<float>")


# The scalars of a segment's features, in their order.
SCALARS = (
    "rms_mean", "rms_std", "f0_mean", "f0_std", "voiced_fraction",
    "spectral_centroid_mean", "spectral_bandwidth_mean", "spectral_flatness_mean",
    "tempo_bpm", "onset_density", "onset_count_energy", "vocal_fraction",
    "emotion_valence", "emotion_arousal", "emotion_dom_conf",
    "snr_db", "words_count", "words_per_sec", "asr_conf_mean",
)


def feature_width(dims: dict[str, int], n_mels: int = 64, n_mfcc: int = 13) -> int:
    return len(SCALARS) + sum(dims.values()) + n_mels + n_mfcc


def newest(df: DataFrame, n: int, rec: str, order: str) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(rec).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def queue(df: DataFrame, priority: str, at: str) -> DataFrame:
    """By descending priority, then time: a distributed sort."""
    return df.orderBy(F.desc(priority), F.asc(at))


def evicted(df: DataFrame, size: str, last_used: str, capacity: float, group: str) -> DataFrame:
    """evicted: whether a cache of `capacity` drops the row, the least recently used first. Rows used at the same time stay or go together."""
    w = Window.partitionBy(group).orderBy(F.desc(last_used)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("evicted", F.sum(size).over(w) > capacity)


def batches(ids: DataFrame, key: str, size: int = 32, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Numbered batches of ids, in order or by a seeded hash.

    Numbers come from each range partition's count, not from one window over all rows, which one task would sort.
    """
    sort = [F.xxhash64(key, F.lit(seed)).alias("_s"), F.col(key)] if shuffle else [F.col(key).alias("_s"), F.col(key)]
    keyed = ids.select("*", sort[0])
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that both reads below are dealt alike
    ranged = keyed.repartitionByRange(parts, "_s", key).sortWithinPartitions("_s", key).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count()
    starts = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_s", key)) - 1
    return ranged.withColumn("_i", place).join(F.broadcast(starts), "_p").select(*ids.columns, F.floor((F.col("_before") + F.col("_i")) / size).cast("long").alias("batch"))
