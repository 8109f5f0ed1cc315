"""Operators on ordered rows: differences, rolling statistics, runs, clusters, merging, peaks, jitter, shimmer.

All take a DataFrame with a recording column, an order column and a value column; a recording is one window
partition, so recordings spread over the cluster and long ones spill instead of filling a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ripplework.functions.statistics import EPS


def ordered(rec: str = "rec_id", order: str = "frame") -> WindowSpec:
    return Window.partitionBy(rec).orderBy(order)


def difference(x: str, w: WindowSpec, n: int = 1) -> Column:
    return F.col(x) - F.lag(x, n).over(w)


def rolling(df: DataFrame, x: str, size: int, stats: tuple[str, ...] = ("mean", "std", "min", "max"), rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """Centred windows of an odd size: mean with zeros beyond the ends counted in, deviation (population), min and max of what is there. Unknown names are skipped."""
    half = size // 2
    w = ordered(rec, order).rowsBetween(-half, half)
    made = {"mean": F.sum(x).over(w) / size, "std": F.stddev_pop(x).over(w), "min": F.min(x).over(w), "max": F.max(x).over(w)}
    return df.withColumns({f"roll_{s}": made[s] for s in stats if s in made})


def delta(df: DataFrame, x: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """delta and delta2: central differences, one-sided at the ends."""
    w = ordered(rec, order)

    def gradient(c: str) -> Column:
        nxt, prev = F.lead(c).over(w), F.lag(c).over(w)
        return F.when(nxt.isNotNull() & prev.isNotNull(), (nxt - prev) / 2).when(nxt.isNotNull(), nxt - F.col(c)).when(prev.isNotNull(), F.col(c) - prev).otherwise(0.0)

    return df.withColumn("delta", gradient(x)).withColumn("delta2", gradient("delta"))


def runs(df: DataFrame, flag: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """start_frame, end_frame (exclusive) and duration_frames of each run of a true flag."""
    w = ordered(rec, order)
    change = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    numbered = df.withColumn("_run", F.sum(change).over(w)).where(flag)
    found = numbered.groupBy(rec, "_run").agg(F.min(order).alias("start_frame"), (F.max(order) + 1).alias("end_frame"), F.count("*").alias("duration_frames"))
    return found.drop("_run")


def label_runs(df: DataFrame, label: str, rec: str = "rec_id", order: str = "frame", t: str = "t") -> DataFrame:
    """Each stretch of an equal label: label, start, end (the next stretch's start, or the last time), frames."""
    w = ordered(rec, order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    own = df.withColumn("_run", F.sum(change).over(w)).groupBy(rec, "_run").agg(F.min_by(label, order).alias("label"), F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("frames"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy(rec).orderBy("_run")), F.col("last"))
    return own.select(rec, F.col("_run").alias("run"), "label", "start", end.alias("end"), "frames")


def gap_clusters(df: DataFrame, gap: float, rec: str = "rec_id", t: str = "t", tie: str = "frame") -> DataFrame:
    """cluster number, start, end and size of rows that follow each other by at most `gap`."""
    w = Window.partitionBy(rec).orderBy(t, tie)
    new = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return df.withColumn("cluster", F.sum(new).over(w)).groupBy(rec, "cluster").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("size"))


def cluster_score(clusters: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Clusters of more than one row, and the share of clusters of more than two among all rows."""
    return clusters.groupBy(rec).agg(F.count_if(F.col("size") > 1).alias("n_clusters"), (F.count_if(F.col("size") > 2) / F.sum("size")).alias("score"))


def merge_intervals(df: DataFrame, gap: float, kind: str, rec: str = "rec_id") -> DataFrame:
    """Intervals (start, end, energy) merged with the one before where that has the same kind and ends at most `gap` earlier; energy is the largest."""
    w = Window.partitionBy(rec).orderBy("start", "end")
    new = F.when((F.lag(kind).over(w) == F.col(kind)) & (F.col("start") - F.lag("end").over(w) <= gap), 0).otherwise(1)
    return df.withColumn("_group", F.sum(new).over(w)).groupBy(rec, "_group").agg(F.min(kind).alias(kind), F.min("start").alias("start"), F.max("end").alias("end"), F.max("energy").alias("energy"), F.count("*").alias("merged")).drop("_group")


def running_confidence(parts: Column) -> Column:
    """Confidence of merged intervals: the mean of the one so far and the next, in order; parts: an ordered array of numbers."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda a, x: (a + x) / 2)


def changes(df: DataFrame, label: str, rec: str = "rec_id", order: str = "turn") -> DataFrame:
    """Where the label differs from the row before: time, from, to, gap."""
    w = ordered(rec, order)
    seen = df.withColumn("from", F.lag(label).over(w)).withColumn("gap", F.col("start") - F.lag("end").over(w))
    return seen.where(F.col("from") != F.col(label)).select(rec, order, F.col("start").alias("time"), "from", F.col(label).alias("to"), "gap")


def transition_rate(df: DataFrame, label: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """Changes of the label, their share of rows, and 1 less that share."""
    moved = F.lag(label).over(ordered(rec, order)) != F.col(label)
    one = df.withColumn("_moved", F.coalesce(moved, F.lit(False))).groupBy(rec).agg(F.count_if("_moved").alias("changes"), F.count("*").alias("n"))
    return one.select(rec, "changes", (F.col("changes") / F.col("n")).alias("rate"), (1 - F.col("changes") / F.col("n")).alias("stability"))


def _relative(total: Column, mean: Column) -> Column:
    return F.when(mean != 0, total / mean).otherwise(0.0)


def jitter(df: DataFrame, period: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """local, rap, ppq5 and ddp: mean deviations of periods from their neighbours, relative to the mean period."""
    w = ordered(rec, order)
    p = F.col(period)
    near = lambda k: F.lag(period, -k).over(w) if k < 0 else F.lead(period, k).over(w)
    parts = df.select(
        rec, p.alias("p"), F.abs(p - near(-1)).alias("local"), F.abs(p - (near(-1) + p + near(1)) / 3).alias("rap"),
        F.abs(p - (near(-2) + near(-1) + near(1) + near(2)) / 4).alias("ppq5"),
    )
    mean = F.avg("p")
    one = parts.groupBy(rec).agg(*[F.coalesce(_relative(F.avg(c), mean), F.lit(0.0)).alias(f"jitter_{c}") for c in ("local", "rap", "ppq5")])
    return one.withColumn("jitter_ddp", 3 * F.col("jitter_rap"))


def shimmer(df: DataFrame, level: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """local, apq3, apq5, apq11 and dda of levels; apq11 is against the mean of 11 rows, the row itself included."""
    w = ordered(rec, order)
    a = F.col(level)
    near = lambda k: F.lag(level, -k).over(w) if k < 0 else F.lead(level, k).over(w)
    eleven = F.when(F.count("*").over(w.rowsBetween(-5, 5)) == 11, F.abs(a - F.avg(level).over(w.rowsBetween(-5, 5))))
    parts = df.select(
        rec, a.alias("a"), F.abs(a - near(-1)).alias("local"), F.abs(a - (near(-1) + a + near(1)) / 3).alias("apq3"),
        F.abs(a - (near(-2) + near(-1) + near(1) + near(2)) / 4).alias("apq5"), eleven.alias("apq11"),
    )
    mean = F.avg("a")
    one = parts.groupBy(rec).agg(*[F.coalesce(_relative(F.avg(c), mean), F.lit(0.0)).alias(f"shimmer_{c}") for c in ("local", "apq3", "apq5", "apq11")])
    return one.withColumn("shimmer_dda", 3 * F.col("shimmer_apq3"))


def peaks(df: DataFrame, x: str, around: int = 3, before: int = 3, after: int = 5, above: float = 0.0, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """Rows that are the largest within `around` rows either way and at least `above` over the mean of the rows from `before` to `after`."""
    w = ordered(rec, order)
    top, mean = F.max(x).over(w.rowsBetween(-around, around)), F.avg(x).over(w.rowsBetween(-before, after))
    return df.withColumn("_top", top).withColumn("_mean", mean).where((F.col(x) == F.col("_top")) & (F.col(x) >= F.col("_mean") + above)).drop("_top", "_mean")


def spaced(df: DataFrame, wait: int, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """Of each recording's rows, in order, those more than `wait` after the last one kept (a fold, for each choice depends on the one before)."""
    rows = df.groupBy(rec).agg(F.array_sort(F.collect_list(F.col(order).cast("long"))).alias("a"))
    kept = F.aggregate("a", F.array().cast("array<bigint>"), lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(F.concat(F.array(F.lit(-(1 << 40))), acc), -1) > wait), F.concat(acc, F.array(i))).otherwise(acc))
    return rows.select(rec, F.explode(kept).alias(order))


def interval_stats(df: DataFrame, t: str = "t", rec: str = "rec_id", tie: str = "frame") -> DataFrame:
    """Of the times between rows: count, mean, std, min, max, variability (std / mean) and regularity 1 / (1 + variability)."""
    w = Window.partitionBy(rec).orderBy(t, tie)
    gaps = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).where("_gap IS NOT NULL")
    one = gaps.groupBy(rec).agg(F.count("*").alias("n"), F.avg("_gap").alias("mean"), F.stddev_pop("_gap").alias("std"), F.min("_gap").alias("min"), F.max("_gap").alias("max"), F.median("_gap").alias("median"))
    var = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return one.withColumn("variability", var).withColumn("regularity", 1 / (1 + F.col("variability")))


def local_tempo(df: DataFrame, t: str = "t", rec: str = "rec_id", tie: str = "frame") -> DataFrame:
    """Tempos 60 / interval between beats: mean, std, min, max, cv, stability, and the mean change from one to the next; 0 without beats."""
    w = Window.partitionBy(rec).orderBy(t, tie)
    tempo = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).withColumn("_tempo", F.when(F.col("_gap") > 0, 60.0 / F.col("_gap"))).withColumn("_change", F.col("_tempo") - F.lag("_tempo").over(w))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    one = tempo.groupBy(rec).agg(z(F.avg("_tempo")).alias("mean"), z(F.stddev_pop("_tempo")).alias("std"), z(F.min("_tempo")).alias("min"), z(F.max("_tempo")).alias("max"), z(F.avg("_change")).alias("acceleration"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return one.withColumn("cv", cv).withColumn("stability", 1 / (1 + F.col("cv")))


def rhythm_pattern(df: DataFrame, t: str = "t", rec: str = "rec_id", tie: str = "frame") -> DataFrame:
    """duple, triple, syncopated or steady, from intervals relative to their mean."""
    w = Window.partitionBy(rec).orderBy(t, tie)
    gaps = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).where("_gap IS NOT NULL")
    g = Window.partitionBy(rec).orderBy(t, tie)
    gaps = gaps.withColumn("_k", F.row_number().over(g) - 1).withColumn("_next", F.lead("_gap").over(g)).withColumn("_rel", F.col("_gap") / F.avg("_gap").over(Window.partitionBy(rec)))
    pair = (F.col("_k") % 2 == 0) & (F.col("_gap") > 0) & (F.col("_next") / F.col("_gap")).between(1.5, 2.5)
    one = gaps.groupBy(rec).agg(F.count("*").alias("n"), (F.count_if(F.col("_rel").between(0.8, 1.2)) / F.count("*")).alias("even"), F.count_if(pair).alias("pairs"), (F.count_if(~F.col("_rel").between(0.7, 1.3)) / F.count("*")).alias("off"))
    label = F.when(F.col("even") > 0.7, "duple").when(F.col("pairs") > F.col("n") / 4, "triple").when(F.col("off") > 0.3, "syncopated").otherwise("steady")
    return one.select(rec, "n", "even", "pairs", "off", label.alias("pattern"))


#: Groups of intervals, best first among equals: beats in a bar.
METERS = (4, 3, 2, 6)


def meter_scores(df: DataFrame, t: str = "t", rec: str = "rec_id", tie: str = "frame") -> DataFrame:
    """meter, score: how alike the intervals are within groups of that many, on average over full groups; one row for each meter that has a group."""
    w = Window.partitionBy(rec).orderBy(t, tie)
    gaps = df.withColumn("_gap", F.col(t) - F.lag(t).over(w)).where("_gap IS NOT NULL").withColumn("_k", F.row_number().over(w) - 1)
    each = gaps.select(rec, "_gap", "_k", F.explode(F.array(*[F.lit(m) for m in METERS])).alias("meter")).withColumn("_group", F.floor(F.col("_k") / F.col("meter")))
    group = each.groupBy(rec, "meter", "_group").agg(F.count("*").alias("n"), F.avg("_gap").alias("m"), F.stddev_pop("_gap").alias("s")).where(F.col("n") == F.col("meter"))
    alike = F.when(F.col("m") > 0, F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("m"))).otherwise(0.0)
    return group.groupBy(rec, "meter").agg(F.avg(alike).alias("score"), F.count("*").alias("groups"))


def best_meter(scores: DataFrame, rec: str = "rec_id") -> DataFrame:
    """The meter of the best score; the one listed first among equals."""
    place = F.array_position(F.array(*[F.lit(m) for m in METERS]), F.col("meter"))
    return scores.groupBy(rec).agg(F.max_by("meter", F.struct("score", -place)).alias("meter"), F.max("score").alias("score"))


def interpolate(df: DataFrame, x: str, rec: str = "rec_id", order: str = "frame") -> DataFrame:
    """x with null and NaN filled linearly between neighbours and on from the two nearest at the ends; 0 with fewer than two values."""
    w = ordered(rec, order)
    v = F.when(~F.isnan(x), F.col(x))
    one = F.when(v.isNotNull(), F.struct(F.col(order).alias("f"), v.alias("v")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = df.withColumn("_v", v).withColumn("_one", one).withColumn("_n", F.count("_one").over(Window.partitionBy(rec)))
    known = known.withColumn("_p", F.last("_one", True).over(back)).withColumn("_q", F.first("_one", True).over(ahead))
    # the two first and the two last values of the recording, for its ends
    whole = Window.partitionBy(rec)
    known = known.withColumn("_r", F.when(F.col("_one").isNotNull(), F.count("_one").over(w)))
    pick = lambda k: F.max(F.when(F.col("_r") == k, F.col("_one"))).over(whole)
    known = known.withColumns({"_a": pick(1), "_b": pick(2), "_y": pick(F.col("_n") - 1), "_z": pick(F.col("_n"))})
    line = lambda a, b: F.col(f"{a}.v") + (F.col(f"{b}.v") - F.col(f"{a}.v")) * (F.col(order) - F.col(f"{a}.f")) / (F.col(f"{b}.f") - F.col(f"{a}.f"))
    filled = F.when(F.col("_n") < 2, 0.0).when(F.col("_v").isNotNull(), F.col("_v")).when(F.col("_p").isNull(), line("_a", "_b")).when(F.col("_q").isNull(), line("_y", "_z")).otherwise(line("_p", "_q"))
    return known.withColumn(f"{x}_filled", filled).drop("_v", "_one", "_n", "_p", "_q", "_r", "_a", "_b", "_y", "_z")


def cumulative_mean(df: DataFrame, x: str, rec: str, order: str) -> DataFrame:
    """The mean of all rows so far."""
    return df.withColumn("mean_so_far", F.avg(x).over(Window.partitionBy(rec).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def variability(x: Column) -> tuple[Column, Column]:
    """std / (mean + eps), and 1 / (1 + that), for agg()."""
    v = F.stddev_pop(x) / (F.avg(x) + EPS)
    return v, 1 / (1 + v)
