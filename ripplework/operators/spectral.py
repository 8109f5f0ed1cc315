"""Spectra as rows (rec_id, frame, bin, freq, mag) and descriptors of them; short transforms in SQL, long ones in dsp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.operators.joins import fold

EPS = 1e-10
FRAME = ["rec_id", "frame"]


def frames(signal: DataFrame, size: int, hop: int, rec: str = "rec_id") -> DataFrame:
    """rec, window, k, x: the samples of every full frame. A sample is in at most ceil(size / hop) frames, found by arithmetic."""
    n = signal.groupBy(rec).agg((F.max("frame") + 1).alias("_n"))
    rows = signal.join(n, rec).withColumn("_last", F.floor((F.col("_n") - size) / hop).cast("long"))
    low = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / hop)).cast("long")
    high = F.least(F.col("_last"), F.floor(F.col("frame") / hop).cast("long"))
    rows = rows.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return rows.select(rec, "window", (F.col("frame") - F.col("window") * hop).alias("k"), "x")


def dft(framed: DataFrame, size: int, sr: float, rec: str = "rec_id") -> DataFrame:
    """Magnitudes of bins 0 to size / 2 of each frame, by multiplication with sines and cosines: for short frames."""
    angle = F.lit(2 * math.pi / size) * (F.col("k") * F.col("bin") % size)
    rows = framed.withColumn("bin", F.explode(F.array(*[F.lit(i).cast("long") for i in range(size // 2 + 1)])))
    re, im = F.sum(F.col("x") * F.cos(angle)), F.sum(F.col("x") * F.sin(angle))
    out = rows.groupBy(rec, F.col("window").alias("frame"), "bin").agg(F.sqrt(re * re + im * im).alias("mag"))
    return out.withColumn("freq", F.col("bin") * F.lit(sr / size))


def folded_frames(embeddings: DataFrame, n: int = 12) -> DataFrame:
    """Vectors as frames of a recording per label: absolute values folded to n bins."""
    x = fold(F.transform("embedding", lambda v: F.abs(v.cast("double"))), n)
    return embeddings.select(F.col("label").alias("rec_id"), F.col("vec_id").alias("frame"), F.posexplode(x).alias("bin", "mag"))


def descriptors(spectra: DataFrame) -> DataFrame:
    """Per frame: centroid, bandwidth, flatness, entropy, energy, and the 85 % rolloff frequency, in two aggregations on one partitioning."""
    w = Window.partitionBy(*FRAME)
    total = F.sum("mag").over(w)
    centroid = F.when(total > 0, F.sum(F.col("freq") * F.col("mag")).over(w) / total).otherwise(0.0)
    so_far = F.sum("mag").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = spectra.withColumns({"_total": total, "_centroid": centroid, "_cum": so_far})
    p = F.when(F.col("_total") > 0, F.col("mag") / F.col("_total")).otherwise(0.0)
    spread = F.when(F.max("_total") > 0, F.sqrt(F.sum(F.pow(F.col("freq") - F.col("_centroid"), 2) * F.col("mag")) / F.max("_total"))).otherwise(0.0)
    level = F.greatest("mag", F.lit(EPS))
    return rows.groupBy(*FRAME).agg(
        F.max("_centroid").alias("centroid"), spread.alias("bandwidth"), (F.exp(F.avg(F.ln(level))) / F.avg(level)).alias("flatness"), (-F.sum(p * F.log2(p + EPS))).alias("entropy"),
        F.sum(F.col("mag") * F.col("mag")).alias("energy"), F.min(F.when(F.col("_cum") >= 0.85 * F.col("_total"), F.col("freq"))).alias("rolloff"),
    )


def flux(spectra: DataFrame) -> DataFrame:
    """Sum over bins of the squared difference to the frame before."""
    before = F.lag("mag").over(Window.partitionBy("rec_id", "bin").orderBy("frame"))
    return spectra.withColumn("_d", F.pow(F.col("mag") - before, 2)).groupBy(*FRAME).agg(F.sum("_d").alias("flux"))


def irregularity(spectra: DataFrame) -> DataFrame:
    """Mean absolute (irregularity) and signed (decrease) difference of adjacent bins, and the slope of log magnitude over frequency."""
    step = F.col("mag") - F.lag("mag").over(Window.partitionBy(*FRAME).orderBy("bin"))
    log = F.ln(F.greatest("mag", F.lit(EPS)))
    rows = spectra.withColumn("_step", step).withColumn("_log", log)
    return rows.groupBy(*FRAME).agg(F.avg(F.abs("_step")).alias("irregularity"), F.avg("_step").alias("decrease"), F.regr_slope("_log", "freq").alias("slope"))


def contrast(spectra: DataFrame, bands: int = 6) -> DataFrame:
    """Largest less smallest magnitude of equally wide bands."""
    n = F.max("bin").over(Window.partitionBy("rec_id")) + 1
    band = F.least(F.floor(F.col("bin") / F.floor(F.greatest(n / bands, F.lit(1)))), F.lit(bands - 1)).cast("int")
    return spectra.withColumn("band", band).groupBy(*FRAME, "band").agg((F.max("mag") - F.min("mag")).alias("contrast"))


def chroma(spectra: DataFrame) -> DataFrame:
    """Pitch classes 0 (C) to 11, each frame scaled to length 1."""
    klass = F.pmod(F.round(12 * F.log2(F.col("freq") / 440.0)).cast("int") + 9, F.lit(12))
    rows = spectra.where("freq >= 20").withColumn("bin", klass).groupBy(*FRAME, "bin").agg(F.sum(F.col("mag") * F.col("mag")).alias("mag"))
    size = F.sqrt(F.sum(F.col("mag") * F.col("mag")).over(Window.partitionBy(*FRAME)))
    return rows.withColumn("mag", F.when(size > 0, F.col("mag") / size).otherwise(0.0))


def chroma_shape(rows: DataFrame) -> DataFrame:
    """Descriptors of frames of few bins, as mean, std, min and max over a recording's frames."""
    total = F.sum("mag").over(Window.partitionBy(*FRAME))
    around = Window.partitionBy(*FRAME).orderBy("bin")
    parts = rows.withColumns({"_p": F.when(total > 0, F.col("mag") / total).otherwise(0.0), "_step": F.abs(F.col("mag") - F.lag("mag").over(around))})
    each = parts.groupBy(*FRAME).agg(
        F.sum("mag").alias("energy"), F.sum(F.col("bin") * F.col("_p")).alias("centroid"), F.stddev_pop("mag").alias("spread"), (-F.sum(F.col("_p") * F.log2(F.col("_p") + EPS))).alias("entropy"),
        F.avg("_step").alias("irregularity"), (F.stddev_pop("mag") / (F.avg("mag") + EPS)).alias("variation"), (F.max("mag") / (F.sum("mag") + EPS)).alias("tonality"),
    )
    each = each.join(flux(rows), FRAME)
    names = ("energy", "centroid", "spread", "entropy", "irregularity", "variation", "tonality", "flux")
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return each.groupBy("rec_id").agg(*[f(n).alias(f"{n}_{s}") for n in names for s, f in stats.items()])


def band_shares(spectra: DataFrame, low: float = 500.0, high: float = 4000.0) -> DataFrame:
    """Shares of energy up to low, between, and from high."""
    e = F.col("mag") * F.col("mag")
    part = lambda c: F.sum(F.when(c, e).otherwise(0.0)) / (F.sum(e) + EPS)
    return spectra.groupBy("rec_id").agg(part(F.col("freq") <= low).alias("low"), part((F.col("freq") > low) & (F.col("freq") < high)).alias("mid"), part(F.col("freq") >= high).alias("high"))


def temporal_snr(signal: DataFrame, size: int, rec: str = "rec_id") -> DataFrame:
    """10 log10 of the mean energy of windows against their 20th percentile; 100 if that is 0. A window that ends with the last sample doesn't count."""
    n = F.max("frame").over(Window.partitionBy(rec)) + 1
    rows = signal.withColumn("_n", n).withColumn("_w", F.floor(F.col("frame") / size)).where((F.col("_w") + 1) * size < F.col("_n"))
    energy = rows.groupBy(rec, "_w").agg((F.sum(F.col("x") * F.col("x")) / size).alias("e"))
    one = energy.groupBy(rec).agg(F.avg("e").alias("m"), F.percentile("e", F.lit(0.2)).alias("p"))
    return one.select(rec, F.when(F.col("p") > 0, 10 * F.log10(F.col("m") / F.col("p"))).otherwise(100.0).alias("snr_db"))


def spectral_snr(spectra: DataFrame) -> DataFrame:
    """10 log10 of the mean spectrum's energy in louder frames against that in frames up to the 10th percentile of energy."""
    energy = spectra.groupBy(*FRAME).agg(F.sum(F.col("mag") * F.col("mag")).alias("_e"))
    edge = energy.groupBy("rec_id").agg(F.percentile("_e", F.lit(0.1)).alias("_p"))
    rows = spectra.join(energy, FRAME).join(edge, "rec_id").withColumn("_noise", F.col("_e") <= F.col("_p"))
    mean = rows.groupBy("rec_id", "_noise", "bin").agg(F.avg("mag").alias("m")).groupBy("rec_id").agg(F.sum(F.when(F.col("_noise"), F.col("m") * F.col("m"))).alias("noise"), F.sum(F.when(~F.col("_noise"), F.col("m") * F.col("m"))).alias("tone"))
    return mean.select("rec_id", F.when((F.col("noise") > 0) & (F.col("tone") > 0), 10 * F.log10(F.col("tone") / F.col("noise"))).when(F.col("tone") > 0, 100.0).otherwise(0.0).alias("snr_db"))


#: Mains hum and its multiples.
HUM = (50.0, 60.0, 100.0, 120.0, 150.0, 180.0)


def hum(spectrum: DataFrame, freqs: tuple[float, ...] = HUM, around: int = 5, times: float = 2.0) -> DataFrame:
    """Whether a whole recording's spectrum (rec_id, bin, freq, mag) stands out at any of freqs against the bins around."""
    w = Window.partitionBy("rec_id").orderBy("bin").rowsBetween(-around, around)
    near = (F.sum("mag").over(w) - F.col("mag")) / (F.count("*").over(w) - 1)
    width = F.max("freq").over(Window.partitionBy("rec_id")) / F.max("bin").over(Window.partitionBy("rec_id"))
    rows = spectrum.withColumns({"_near": near, "_width": width})
    hit: Column = F.lit(False)
    for f in freqs:
        hit = hit | ((F.round(F.lit(f) / F.col("_width")) == F.col("bin")) & (F.col("mag") > times * F.col("_near")))
    return rows.groupBy("rec_id").agg(F.bool_or(hit).alias("hum_detected"))


def distortion(spectrum: DataFrame, base: float = 440.0, harmonics: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """thd: root of the harmonics' energy over the base's, by nearest bins; distorted where that exceeds 0.1 and flatness 0.5."""
    width = F.max("freq").over(Window.partitionBy("rec_id")) / F.max("bin").over(Window.partitionBy("rec_id"))
    at = F.round(F.col("freq") / base)
    near = F.abs(F.col("freq") - at * base) <= width / 2
    rows = spectrum.withColumns({"_at": F.when(near, at), "_e": F.col("mag") * F.col("mag")})
    level = F.greatest("mag", F.lit(EPS))
    one = rows.groupBy("rec_id").agg(
        F.sqrt(F.sum(F.when(F.col("_at").isin(*harmonics), F.col("_e")))).alias("_h"), F.sqrt(F.sum(F.when(F.col("_at") == 1, F.col("_e")))).alias("_b"), (F.exp(F.avg(F.ln(level))) / F.avg(level)).alias("flatness"),
    )
    thd = F.coalesce(F.when(F.col("_b") > 0, F.col("_h") / F.col("_b")), F.lit(0.0))
    return one.select("rec_id", thd.alias("thd"), "flatness").withColumn("distorted", (F.col("thd") > 0.1) & (F.col("flatness") > 0.5))


def zero_crossings(signal: DataFrame, rec: str = "rec_id") -> DataFrame:
    """zcr: the share of steps at which the sign changes; turning_rate: the share at which the direction does."""
    w = Window.partitionBy(rec).orderBy("frame")
    sign = F.when(F.col("x") < 0, -1).otherwise(1)
    rows = signal.withColumn("_s", sign).withColumn("_d", F.signum(F.col("x") - F.lag("x").over(w)))
    rows = rows.withColumn("_z", F.col("_s") != F.lag("_s").over(w)).withColumn("_t", F.col("_d") != F.lag("_d").over(w))
    return rows.groupBy(rec).agg(F.avg(F.col("_z").cast("int")).alias("zcr"), F.avg(F.col("_t").cast("int")).alias("turning_rate"))


def rms_frames(signal: DataFrame, size: int = 2048, hop: int = 512, rec: str = "rec_id") -> DataFrame:
    """Root mean square of frames centred on every hop-th sample, zeros beyond the ends."""
    half = size // 2
    sq = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(rec).orderBy("frame").rangeBetween(-half, half - 1))
    rows = signal.withColumn("_r", F.sqrt(sq / size)).where(F.col("frame") % hop == 0)
    return rows.select(rec, (F.col("frame") / hop).cast("long").alias("frame"), F.col("_r").alias("rms"))


def voice_activity(signal: DataFrame, size: int, threshold: float, rec: str = "rec_id") -> DataFrame:
    """Frames without overlap whose root mean square exceeds a share of the recording's loudest frame; a stand-in for a trained detector."""
    rows = signal.withColumn("_w", F.floor(F.col("frame") / size)).groupBy(rec, "_w").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("_n")).where(F.col("_n") == size)
    loud = F.max("rms").over(Window.partitionBy(rec))
    return rows.select(rec, F.col("_w").alias("frame"), "rms", (F.col("rms") > threshold * loud).alias("voiced"))
