"""Queries for statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplework.functions import scoring
from ripplework.functions import statistics as st
from ripplework.operators import selection, sequence
from ripplework.plans.registry import INTERVALS, NUDGE, SIGNAL, VECTORS, query, round_all, rounded
from ripplework.sources import signals


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.events_signal(spark, sf_dir)


_MOMENTS = "moments AS (SELECT *, avg(x) OVER (PARTITION BY rec_id) AS mu FROM signal)"
_SEVENTEEN = "mean std var min max median p25 p75 p90 p95 p99 skewness kurtosis cv range iqr entropy"


@query(
    f"""SELECT rec_id, {rounded(_SEVENTEEN)} FROM (
      SELECT rec_id, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var, min(x) AS min, max(x) AS max, quantile_disc(x, 0.5) AS median,
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99,
        avg(pow(x - mu, 3)) / pow(stddev_samp(x), 3) AS skewness, avg(pow(x - mu, 4)) / pow(stddev_samp(x), 4) - 3 AS kurtosis,
        stddev_samp(x) / (avg(x) + 1e-10) AS cv, max(x) - min(x) AS range, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
        -sum((abs(x) + 1e-10) / total * log2((abs(x) + 1e-10) / total + 1e-10)) AS entropy
      FROM (SELECT *, sum(abs(x) + 1e-10) OVER (PARTITION BY rec_id) AS total FROM moments) GROUP BY rec_id)""",
    SIGNAL, _MOMENTS,
)
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    one = s.groupBy("rec_id").agg(*st.named(st.full("x"), None))
    return round_all(one.join(st.entropy(s, ["rec_id"], "x"), "rec_id"), _SEVENTEEN)


@query(
    f"""SELECT rec_id, {rounded('mean std min max median skewness kurtosis')} FROM (
      SELECT rec_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS median,
        CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 THEN avg(pow(x - mu, 3)) / pow(stddev_pop(x), 3) ELSE 0 END AS skewness,
        CASE WHEN count(*) >= 4 AND stddev_pop(x) > 0 THEN avg(pow(x - mu, 4)) / pow(stddev_pop(x), 4) - 3 ELSE 0 END AS kurtosis
      FROM moments GROUP BY rec_id)""",
    SIGNAL, _MOMENTS,
)
def signal_stats_np(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return round_all(_signal(spark, sf_dir).groupBy("rec_id").agg(*st.named(st.basic(x) | {"skewness": st.skewness_pop(x), "kurtosis": st.kurtosis_pop(x)}, None)), "mean std min max median skewness kurtosis")


@query(f"SELECT event_type, {rounded('mean std min max median p25 p75 p90 cv')} FROM (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, stddev_samp(value) / (avg(value) + 1e-10) AS cv FROM events GROUP BY event_type)")
def nine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "events").groupBy("event_type").agg(*[(F.round(c + NUDGE, 6)).alias(k) for k, c in st.nine(F.col("value")).items()])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(var_samp(value), 4) AS var, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type")
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return signals.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.var_samp(v), 4).alias("var"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.percentile(F.col("value"), 0.1, 0.5, 0.9)
    return signals.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(p[0], 6).alias("p10"), F.round(p[1], 6).alias("p50"), F.round(p[2], 6).alias("p90"))


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS median_low FROM events GROUP BY event_type")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(st.median_low("value"), 6).alias("median_low"))


@query("SELECT user_id, round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM (SELECT user_id, (abs(value) + 1e-10) / sum(abs(value) + 1e-10) OVER (PARTITION BY user_id) AS p FROM events) GROUP BY user_id")
def entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.entropy(signals.table(spark, sf_dir, "events"), ["user_id"], "value"), "entropy")


@query(
    """SELECT round(sum(c / n * log2(c * n / (ci * cj))), 6) AS mi FROM (
      SELECT i, j, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY i) AS DOUBLE) AS ci, CAST(sum(count(*)) OVER (PARTITION BY j) AS DOUBLE) AS cj, CAST(sum(count(*)) OVER () AS DOUBLE) AS n
      FROM (SELECT ceil((l_quantity - x0) / (x1 - x0) * 10) - 1 AS i, ceil((l_extendedprice - y0) / (y1 - y0) * 10) - 1 AS j
        FROM lineitem, (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)) WHERE i >= 0 AND j >= 0 GROUP BY i, j)"""
)
def mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.mutual_information(signals.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "mi")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM lineitem" for a in _CORR for b in _CORR))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.correlation_matrix(signals.table(spark, sf_dir, "lineitem"), list(_CORR)), "r")


@query("SELECT l_returnflag, l_linestatus, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(st.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query(
    f"""SELECT rec_id, {rounded('peak peak_to_peak crest')}, count_high, {rounded('high_share clip_share hard_share severity')} FROM (
      SELECT rec_id, max(abs(y)) AS peak, max(y) - min(y) AS peak_to_peak, max(abs(y)) / sqrt(avg(y * y)) AS crest,
        count(*) FILTER (abs(y) >= 0.95) AS count_high, avg(CASE WHEN abs(y) >= 0.95 THEN 1e0 ELSE 0 END) AS high_share,
        avg(CASE WHEN abs(y) >= 0.99 THEN 1e0 ELSE 0 END) AS clip_share, avg(CASE WHEN abs(y) >= 1 THEN 1e0 ELSE 0 END) AS hard_share,
        coalesce(avg(CASE WHEN abs(y) >= 0.99 THEN abs(y) - 0.99e0 END), 0) AS severity
      FROM (SELECT rec_id, x / greatest(max(abs(x)) OVER (PARTITION BY rec_id), 1e-8) AS y FROM signal) GROUP BY rec_id)""",
    SIGNAL,
)
def peak_clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir).select("rec_id", selection.peak_normalise("x").alias("y"))
    y, a = F.col("y"), F.abs(F.col("y"))
    share = lambda c: F.avg(c.cast("int"))
    one = s.groupBy("rec_id").agg(
        F.max(a).alias("peak"), (F.max(y) - F.min(y)).alias("peak_to_peak"), (F.max(a) / F.sqrt(F.avg(y * y))).alias("crest"), F.count_if(a >= 0.95).alias("count_high"),
        share(a >= 0.95).alias("high_share"), share(a >= 0.99).alias("clip_share"), share(a >= 1).alias("hard_share"), F.coalesce(F.avg(F.when(a >= 0.99, a - 0.99)), F.lit(0.0)).alias("severity"),
    )
    return round_all(one, "peak peak_to_peak crest high_share clip_share hard_share severity")


@query(f"SELECT rec_id, {rounded('mean std min max median p25 p75 range cv energy_mean energy_std dynamic_range')} FROM (SELECT rec_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, max(x) - min(x) AS range, CASE WHEN avg(x) > 0 THEN stddev_pop(x) / avg(x) ELSE 0 END AS cv, avg(x * x) AS energy_mean, stddev_pop(x * x) AS energy_std, max(abs(x)) / (sqrt(avg(x * x)) + 1e-10) AS dynamic_range FROM signal GROUP BY rec_id)", SIGNAL)
def rms_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    stats = st.basic(x) | {"p25": st.percentile(x, 0.25), "p75": st.percentile(x, 0.75), "range": F.max(x) - F.min(x), "cv": st.variation(F.stddev_pop(x), F.avg(x)), "energy_mean": F.avg(x * x), "energy_std": F.stddev_pop(x * x), "dynamic_range": F.max(F.abs(x)) / (F.sqrt(F.avg(x * x)) + st.EPS)}
    return _signal(spark, sf_dir).groupBy("rec_id").agg(*[F.round(c + NUDGE, 6).alias(k) for k, c in stats.items()])


@query(f"SELECT label, pos, {rounded('mean std min max')} FROM (SELECT label, pos, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM vectors GROUP BY GROUPING SETS ((label, pos), (label)))", VECTORS)
def grouping_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    rows = signals.vectors(signals.table(spark, sf_dir, "embeddings"))
    return rows.groupingSets([["label", "pos"], ["label"]], "label", "pos").agg(*[F.round(c + NUDGE, 6).alias(k) for k, c in {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}.items()])


@query(f"SELECT rec_id, n, {rounded('mean std p25 p75 range cv stability')} FROM (SELECT rec_id, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, max(x) - min(x) AS range, CASE WHEN avg(x) > 0 THEN stddev_pop(x) / avg(x) ELSE 0 END AS cv, 1 / (1 + CASE WHEN avg(x) > 0 THEN stddev_pop(x) / avg(x) ELSE 0 END) AS stability FROM signal WHERE voiced GROUP BY rec_id)", SIGNAL)
def voiced_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    cv = st.variation(F.stddev_pop(x), F.avg(x))
    stats = {"mean": F.avg(x), "std": F.stddev_pop(x), "p25": st.percentile(x, 0.25), "p75": st.percentile(x, 0.75), "range": F.max(x) - F.min(x), "cv": cv, "stability": 1 / (1 + cv)}
    return _signal(spark, sf_dir).where(F.col("voiced") & ~F.isnan("x")).groupBy("rec_id").agg(F.count("*").alias("n"), *[F.round(c + NUDGE, 6).alias(k) for k, c in stats.items()])


@query("SELECT rec_id, round(coalesce(avg(x) FILTER (event_type = 'signup'), avg(x) FILTER (event_type = 'purchase'), avg(x) FILTER (event_type = 'error')), 6) AS best, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'signup' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'purchase' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' END AS method FROM signal GROUP BY rec_id", SIGNAL)
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = ("signup", "purchase", "error")
    mean = lambda m: F.avg(F.when(F.col("event_type") == m, F.col("x")))
    name = lambda m: F.when(F.count_if(F.col("event_type") == m) > 0, m)
    return _signal(spark, sf_dir).groupBy("rec_id").agg(F.round(F.coalesce(*map(mean, methods)), 6).alias("best"), F.coalesce(*map(name, methods)).alias("method"))


@query("SELECT rec_id, first, second, third, CASE WHEN first >= second AND first >= third THEN 'beginning' WHEN second >= third THEN 'middle' ELSE 'end' END AS densest FROM (SELECT rec_id, round(count(*) FILTER (third = 0) / (d / 3), 6) AS first, round(count(*) FILTER (third = 1) / (d / 3), 6) AS second, round(count(*) FILTER (third = 2) / (d / 3), 6) AS third FROM (SELECT rec_id, d, least(CAST(floor(t / (d / 3)) AS BIGINT), 2) AS third FROM (SELECT *, max(t) OVER (PARTITION BY rec_id) AS d FROM signal) WHERE d > 0) GROUP BY rec_id, d)", SIGNAL)
def density_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir).withColumn("d", F.max("t").over(Window.partitionBy("rec_id"))).where("d > 0")
    part = F.least(F.floor(F.col("t") / (F.col("d") / 3)), F.lit(2))
    one = s.withColumn("part", part).groupBy("rec_id").agg(*[F.round(F.count_if(F.col("part") == i) / (F.max("d") / 3), 6).alias(n) for i, n in enumerate(("first", "second", "third"))])
    label = F.when((F.col("first") >= F.col("second")) & (F.col("first") >= F.col("third")), "beginning").when(F.col("second") >= F.col("third"), "middle").otherwise("end")
    return one.withColumn("densest", label)


@query("SELECT rec_id, round(p75, 6) AS p75, round(avg(CASE WHEN x > p75 THEN 1e0 ELSE 0 END), 6) AS strong_share FROM (SELECT rec_id, x, quantile_cont(x, 0.75) OVER (PARTITION BY rec_id) AS p75 FROM signal) GROUP BY rec_id, p75", SIGNAL)
def strength_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, sf_dir)
    p = s.groupBy("rec_id").agg(st.percentile(F.col("x"), 0.75).alias("p75"))
    return round_all(s.join(p, "rec_id").groupBy("rec_id", "p75").agg(F.avg((F.col("x") > F.col("p75")).cast("int")).alias("strong_share")), "p75 strong_share")


@query("SELECT rec_id, arg_max(event_type, (n, -ord)) AS most_common, round(count(*) / sum(n), 6) AS diversity, CAST(sum(n) AS BIGINT) AS total FROM (SELECT rec_id, event_type, count(*) AS n, ascii(event_type) * 1000 + length(event_type) AS ord FROM signal GROUP BY rec_id, event_type) GROUP BY rec_id", SIGNAL)
def label_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _signal(spark, sf_dir).groupBy("rec_id", "event_type").agg(F.count("*").alias("n"))
    order = F.struct(F.col("n"), -(F.ascii("event_type") * 1000 + F.length("event_type")))
    return counts.groupBy("rec_id").agg(F.max_by("event_type", order).alias("most_common"), F.round(F.count("*") / F.sum("n"), 6).alias("diversity"), F.sum("n").alias("total"))


_TOTALS = "totals AS (SELECT rec_id, speaker, CAST(sum(\"end\" - \"start\") AS BIGINT) AS total FROM intervals GROUP BY rec_id, speaker)"


@query("SELECT rec_id, speaker, total, round(CASE WHEN all_ > 0 THEN total / all_ ELSE 0 END, 6) AS share FROM (SELECT *, CAST(sum(total) OVER (PARTITION BY rec_id) AS BIGINT) AS all_ FROM totals)", INTERVALS, _TOTALS)
def speaker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.intervals_from_turns(signals.table(spark, sf_dir, "conversations"))
    total = rows.groupBy("rec_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    all_ = F.sum("total").over(Window.partitionBy("rec_id"))
    return total.withColumn("share", F.round(F.when(all_ > 0, F.col("total") / all_).otherwise(0.0), 6))


@query("SELECT rec_id, k, round(CASE WHEN k > 1 THEN h / log2(k) ELSE 1 END, 6) AS balance, dominant FROM (SELECT rec_id, count(*) AS k, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS h, arg_max(speaker, (total, speaker)) AS dominant FROM (SELECT *, total / greatest(sum(total) OVER (PARTITION BY rec_id), 1) AS p FROM totals) GROUP BY rec_id)", INTERVALS, _TOTALS)
def speaker_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.intervals_from_turns(signals.table(spark, sf_dir, "conversations"))
    total = rows.groupBy("rec_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    p = F.col("total") / F.greatest(F.sum("total").over(Window.partitionBy("rec_id")), F.lit(1))
    one = total.withColumn("p", p).groupBy("rec_id").agg(F.count("*").alias("k"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("h"), F.max_by("speaker", F.struct("total", "speaker")).alias("dominant"))
    return one.select("rec_id", "k", F.round(F.when(F.col("k") > 1, F.col("h") / F.log2(F.col("k").cast("double"))).otherwise(1.0), 6).alias("balance"), "dominant")


@query(f"SELECT user_id, {rounded('mean std min max confidence')} FROM (SELECT user_id, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, max(p) AS max, CASE WHEN avg(p) >= 0.8 THEN 0.9e0 WHEN avg(p) >= 0.6 THEN 0.7e0 WHEN avg(p) >= 0.4 THEN 0.5e0 ELSE 0.3e0 END AS confidence FROM (SELECT user_id, exp(-value / 100) AS p FROM events) GROUP BY user_id)")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = signals.table(spark, sf_dir, "events").select("user_id", F.exp(-F.col("value") / 100).alias("p"))
    return rows.groupBy("user_id").agg(*[F.round(c + NUDGE, 6).alias(k) for k, c in {"mean": F.avg(p), "std": F.stddev_pop(p), "min": F.min(p), "max": F.max(p), "confidence": scoring.confidence(F.avg(p))}.items()])


@query("SELECT rec_id, round(count(*) FILTER (voiced) / greatest(max(t), 1e-9), 6) AS rate, round(avg(gap), 6) AS gap_mean, round(stddev_pop(gap), 6) AS gap_std, round(stddev_pop(CASE WHEN gap > 0 THEN 1 / gap END), 4) AS tempo_std FROM (SELECT *, lead(t) OVER (PARTITION BY rec_id ORDER BY frame) - t AS gap FROM signal) GROUP BY rec_id", SIGNAL)
def phoneme_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lead("t").over(sequence.ordered()) - F.col("t")
    s = _signal(spark, sf_dir).withColumn("gap", gap)
    return s.groupBy("rec_id").agg(F.round(F.count_if("voiced") / F.greatest(F.max("t"), F.lit(1e-9)), 6).alias("rate"), F.round(F.avg("gap"), 6).alias("gap_mean"), F.round(F.stddev_pop("gap"), 6).alias("gap_std"), F.round(F.stddev_pop(F.when(F.col("gap") > 0, 1 / F.col("gap"))), 4).alias("tempo_std"))


@query("SELECT rec_id, round(stddev_pop(x) / (avg(x) + 1e-10), 6) AS variability, round(1 / (1 + stddev_pop(x) / (avg(x) + 1e-10)), 6) AS stability FROM signal GROUP BY rec_id", SIGNAL)
def variability_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = sequence.variability(F.col("x"))
    return _signal(spark, sf_dir).groupBy("rec_id").agg(F.round(v, 6).alias("variability"), F.round(s, 6).alias("stability"))


@query(
    """, e AS (SELECT rec_id, CAST(frame // 5 AS BIGINT) AS w, sum(x * x) / 5 AS energy FROM signal GROUP BY ALL HAVING count(*) = 5),
      n AS (SELECT rec_id, count(*) AS frames FROM signal GROUP BY rec_id)
      SELECT rec_id, round(CASE WHEN p20 > 0 THEN 10 * log10(m / p20) ELSE 100 END, 6) AS snr_db FROM (
        SELECT e.rec_id, avg(energy) AS m, quantile_cont(energy, 0.2) AS p20 FROM e JOIN n ON e.rec_id = n.rec_id WHERE (w + 1) * 5 < frames GROUP BY e.rec_id)""",
    SIGNAL,
)
def temporal_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.operators.spectral import temporal_snr as snr

    return round_all(snr(_signal(spark, sf_dir), 5), "snr_db")


@query(f"SELECT rec_id, {rounded('mean std min max l2 abs_mean abs_std energy sparsity entropy', 5)} FROM (SELECT rec_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, sqrt(sum(v * v)) AS l2, avg(abs(v)) AS abs_mean, stddev_pop(abs(v)) AS abs_std, sum(v * v) AS energy, avg(CASE WHEN abs(v) < 1e-6 THEN 1e0 ELSE 0 END) AS sparsity, -sum(abs(v) / total * ln(abs(v) / total + 1e-10)) AS entropy FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY rec_id) AS total FROM vectors) GROUP BY rec_id)", VECTORS)
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.operators.embedding import vector_stats

    return round_all(vector_stats(signals.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "rec_id")), "mean std min max l2 abs_mean abs_std energy sparsity entropy", 5)


@query("SELECT event_type, le, CAST(n AS BIGINT) AS n FROM (SELECT event_type, e AS le, count(*) FILTER (value <= e) AS n FROM events, (SELECT unnest([10e0, 50e0, 100e0, 250e0]) AS e) GROUP BY event_type, e UNION ALL SELECT event_type, NULL, count(value) FROM events GROUP BY event_type)")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(signals.table(spark, sf_dir, "events"), ["event_type"], "value", [10.0, 50.0, 100.0, 250.0])


@query("SELECT rec_id, frame, round(avg(x) OVER (PARTITION BY rec_id ORDER BY frame) + 1e-9, 6) AS mean_so_far FROM signal", SIGNAL)
def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(sequence.cumulative_mean(_signal(spark, sf_dir), "x", "rec_id", "frame").select("rec_id", "frame", "mean_so_far"), "mean_so_far")


_FRAMES = "f AS (SELECT label AS rec_id, vec_id AS frame, i AS bin, (SELECT sum(abs(CAST(embedding[k] AS DOUBLE))) FROM (SELECT unnest(range(1, 65)) AS k) WHERE (k - 1) % 12 = i) AS m FROM embeddings, (SELECT unnest(range(0, 12)) AS i))"


@query(
    """, s AS (SELECT rec_id, frame, sum(m) AS energy, sum(bin * m) / sum(m) AS centroid, stddev_pop(m) AS dev, -sum(m / t * log2(m / t + 1e-10)) AS entropy FROM (SELECT *, sum(m) OVER (PARTITION BY rec_id, frame) AS t FROM f) GROUP BY rec_id, frame),
      d AS (SELECT rec_id, frame, sum(pow(m - p, 2)) AS flux FROM (SELECT *, lag(m) OVER (PARTITION BY rec_id, bin ORDER BY frame) AS p FROM f) GROUP BY rec_id, frame)
      SELECT s.rec_id, round(avg(energy), 5) AS energy_mean, round(stddev_pop(energy), 5) AS energy_std, round(avg(centroid), 5) AS centroid_mean, round(avg(entropy), 5) AS entropy_mean, round(avg(flux), 5) AS flux_mean, round(max(flux), 5) AS flux_max
      FROM s JOIN d ON s.rec_id = d.rec_id AND s.frame = d.frame GROUP BY s.rec_id""",
    _FRAMES,
)
def chroma_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.operators import spectral

    one = spectral.chroma_shape(spectral.folded_frames(signals.table(spark, sf_dir, "embeddings")))
    return round_all(one.select("rec_id", "energy_mean", "energy_std", "centroid_mean", "entropy_mean", "flux_mean", "flux_max"), "energy_mean energy_std centroid_mean entropy_mean flux_mean flux_max", 5)
