"""From recordings to manifests, segments and feature tensors: what a caller runs from end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.binding import let
from ripplework.operators import segments as seg
from ripplework.operators import selection as sel
from ripplework.operators.embedding import Compressor
from ripplework.operators.segments import SegmentConfig
from ripplework.plans import extractors
from ripplework.session import shared_path
from ripplework.sources import manifests, tensors

MODES = ("aggregates_only", "segments_only", "both")
#: Canonical names of the extractors whose results a recording's segments share: column -> (extractor, field).
RECORDING_FEATURES = {
    "tempo_bpm": ("tempo", "tempo_bpm"), "onset_density": ("onset", "onset_density"), "onset_count_energy": ("onset", "onset_count_energy"), "vocal_fraction": ("source_separation", "vocal_fraction"),
    "emotion_valence": ("emotion_recognition", "emotion_valence"), "emotion_arousal": ("emotion_recognition", "emotion_arousal"), "emotion_dom_conf": ("emotion_recognition", "emotion_dom_conf"), "snr_db": ("quality", "snr_db"),
    "spectral_centroid_mean": ("spectral_extractor", "spectral_centroid_mean"), "spectral_bandwidth_mean": ("spectral_extractor", "spectral_bandwidth_mean"), "spectral_flatness_mean": ("spectral_extractor", "spectral_flatness_mean"),
    "words_count": ("asr_extractor", "words_count"), "words_per_sec": ("asr_extractor", "words_per_sec"), "asr_conf_mean": ("asr_extractor", "confidence_mean"), "f0_mean": ("vad_extractor", "f0_mean"), "f0_std": ("vad_extractor", "f0_std"),
}


@dataclass
class Output:
    mode: str
    manifests: DataFrame | None = None
    segments: DataFrame | None = None
    tensors: DataFrame | None = None
    compressor: Compressor | None = None


def frames(recordings: DataFrame, sr: int = 22050, size: int = 2048, hop: int = 512, rec: str = "rec_id") -> DataFrame:
    """rec, frame, t, x (level) and voiced of each hop of a recording's samples, without a shuffle; sr where recordings don't have their own."""
    rate = F.col("sr") if "sr" in recordings.columns else F.lit(sr)
    def levels(x: Column) -> Column:
        part = lambda i: F.slice(x, F.greatest(i * hop - size // 2, F.lit(0)) + 1, F.lit(size))
        last = F.greatest(F.floor(F.size(x) / hop).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.sqrt(F.aggregate(part(i), F.lit(0.0), lambda a, v: a + v * v) / size))

    level = let(F.col("x"), levels)
    rows = recordings.select(rec, rate.cast("double").alias("_sr"), level.alias("_l")).withColumn("_top", F.array_max("_l"))
    out = rows.select(rec, "_sr", "_top", F.posexplode("_l").alias("frame", "x"))
    return out.select(rec, "frame", (F.col("frame") * hop / F.col("_sr")).alias("t"), "x", (F.col("x") > 0.1 * F.col("_top")).alias("voiced"))


def segment_rows(framed: DataFrame, features: DataFrame | None, config: SegmentConfig, rec: str = "rec_id") -> DataFrame:
    """Every segment with its own statistics and its recording's features; low transcript confidences become null."""
    own = seg.aggregate_segments(framed, config.segment_len, config.hop, rec)
    rows = own.withColumnsRenamed({"x_mean": "rms_mean", "x_std": "rms_std", "x_max": "rms_max"})
    if features is not None:
        rows = rows.join(features, rec, "left")
    for name in sel.SCALARS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    return rows.withColumn("asr_conf_mean", F.when(F.col("asr_conf_mean") >= config.asr_confidence, F.col("asr_conf_mean")))


def feature_tensors(rows: DataFrame, config: SegmentConfig, embeddings: dict[str, str] | None = None, rec: str = "rec_id", strategy: str = "boundary_importance", spectra: tuple[str, ...] = ()) -> DataFrame:
    """Selected segments as tensors of max_seq_len rows. embeddings: kind -> column of compressed vectors; spectra: columns of mel and cepstrum means."""
    kept = sel.select(rows, strategy, config.max_seq_len, config.k_start, config.k_end, rec=rec)
    given = embeddings or {}
    mels = (config.n_mels, config.n_mfcc) if spectra else (0, 0)
    width = sel.feature_width({k: config.pca_dims[k] for k in given}, *mels)
    flat = sel.flatten([F.col(c) for c in sel.SCALARS], [F.col(c) for c in given.values()], [F.col(c) for c in spectra], width)
    placed = sel.ranked(kept, rec).where(F.col("_i") < config.max_seq_len).select(rec, F.col("_i").cast("long").alias("pos"), flat.alias("features"), F.lit(1).alias("mask"))
    grid = kept.select(rec).distinct().select(rec, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.max_seq_len - 1).cast("long"))).alias("pos"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    full = grid.join(placed, [rec, "pos"], "left").select(rec, "pos", F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("features", zero).alias("features"))
    return tensors.assemble(full, rec)


def process(
    recordings: DataFrame, mode: str = "both", config: SegmentConfig | None = None, names: list[str] | None = None, dataset: str = "default", sr: int = 22050, vectors: DataFrame | None = None
) -> Output:
    """Manifests, segments or both of recordings (rec_id, x; sr where they have their own rates).

    Extractors run once whatever the mode: their results are written to the shared folder, and what is returned reads
    them. With vectors (rec_id, segment_index, kind, embedding), compressed to config.pca_dims, and with its means of
    mel and cepstrum, a segment's row is the full one (416 wide by default); without, it has the scalars alone.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    config = config or SegmentConfig()
    path = shared_path(recordings.sparkSession, "results")
    extractors.extract(recordings, names, sr=sr).write.parquet(path)
    found = recordings.sparkSession.read.schema(extractors.RESULTS).parquet(path)
    out = Output(mode)
    if mode != "segments_only":
        out.manifests = manifests.build(found, dataset)
    if mode != "aggregates_only":
        features = manifests.features(found, RECORDING_FEATURES).withColumnRenamed("video_id", "rec_id")
        named = recordings.withColumn("rec_id", F.col("rec_id").cast("string"))
        out.segments = segment_rows(frames(named, sr), features, config)
        if vectors is None:
            out.tensors = feature_tensors(out.segments, config)
        else:
            made, out.compressor = compress(vectors.withColumn("rec_id", F.col("rec_id").cast("string")), config)
            columns = {k: f"{k}_pca" for k in config.pca_dims}
            key = ["rec_id", "segment_index"]
            wide = made.groupBy(*key).agg(*[F.max(F.when(F.col("kind") == k, F.col("pca"))).alias(c) for k, c in columns.items()])
            out.segments = out.segments.join(wide, key, "left").join(extractors.segment_spectra(named, config, sr=sr), key, "left")
            out.tensors = feature_tensors(out.segments, config, columns, spectra=("mel", "mfcc"))
    return out


def compress(segment_vectors: DataFrame, config: SegmentConfig) -> tuple[DataFrame, Compressor]:
    """Vectors (kind, embedding) with their principal components, and the fitted models: fitting reads all recordings once."""
    model = Compressor(config.pca_dims).fit(segment_vectors)
    return model.transform(segment_vectors), model


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts and times of the manifests kept at a path."""
    return manifests.totals(manifests.results(manifests.read(spark, path)))


__all__ = ["Output", "compress", "feature_tensors", "frames", "process", "segment_rows", "totals"]
