"""Statistics as Column builders: each returns expressions for one agg(), so that a bundle costs one shuffle.

Conventions differ between uses, so they are named: *_pop divides by n, *_samp by n - 1; `median` interpolates,
`median_low` is the lower of the two middle values. Null and NaN are left out by `finite`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def finite(x: Column) -> Column:
    """x, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


def percentile(x: Column, *qs: float) -> Column:
    """Exact, linearly interpolated; of bounded groups (a recording), not of whole tables."""
    return F.percentile(x, F.array(*[F.lit(q) for q in qs])) if len(qs) > 1 else F.percentile(x, F.lit(qs[0]))


def median_low(name: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")


def skewness_samp(x: Column) -> Column:
    """Mean cube of (x - mean) / sample deviation."""
    n = F.count(x)
    return F.when(F.stddev_samp(x) > 0, F.skewness(x) * F.pow((n - 1) / n, 1.5)).otherwise(0.0)


def kurtosis_samp(x: Column) -> Column:
    """Mean fourth power of (x - mean) / sample deviation, less 3."""
    n = F.count(x)
    return F.when(F.stddev_samp(x) > 0, (F.kurtosis(x) + 3) * F.pow((n - 1) / n, 2) - 3).otherwise(0.0)


def skewness_pop(x: Column) -> Column:
    return F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 0), F.skewness(x)).otherwise(0.0)


def kurtosis_pop(x: Column) -> Column:
    return F.when((F.count(x) >= 4) & (F.stddev_pop(x) > 0), F.kurtosis(x)).otherwise(0.0)


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation, 0 unless the mean is positive."""
    return F.when(mean > 0, std / mean).otherwise(0.0)


def basic(x: Column, ddof: int = 0) -> dict[str, Column]:
    """mean, std, min, max, median; ddof 0 or 1."""
    return {"mean": F.avg(x), "std": F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "median": F.median(x)}


def by_name(x: Column, kind: str) -> Column:
    """One of mean, std, max, min, median; null for anything else."""
    return basic(x).get(kind, F.lit(None).cast("double"))


def nine(x: Column) -> dict[str, Column]:
    """mean, std (sample), min, max, median, p25, p75, p90, cv."""
    p = {f"p{int(100 * q)}": percentile(x, q) for q in (0.25, 0.75, 0.9)}
    return basic(x, ddof=1) | p | {"cv": F.stddev_samp(x) / (F.avg(x) + EPS)}


def full(name: str) -> dict[str, Column]:
    """All but entropy, which needs a total first (see entropy)."""
    x = F.col(name)
    p = percentile(x, 0.25, 0.75, 0.9, 0.95, 0.99)
    return {
        "mean": F.avg(x), "std": F.stddev_samp(x), "var": F.var_samp(x), "min": F.min(x), "max": F.max(x), "median": median_low(name),
        "p25": p[0], "p75": p[1], "p90": p[2], "p95": p[3], "p99": p[4], "skewness": skewness_samp(x), "kurtosis": kurtosis_samp(x),
        "cv": F.stddev_samp(x) / (F.avg(x) + EPS), "range": F.max(x) - F.min(x), "iqr": p[1] - p[0],
    }


def named(stats: dict[str, Column], digits: int | None = 6, prefix: str = "") -> list[Column]:
    return [(F.round(c, digits) if digits is not None else c).alias(f"{prefix}{k}") for k, c in stats.items()]


def entropy(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Shannon entropy in bits of |x| as shares of its group's total. The total is joined, so no group is held in a task."""
    size = F.abs(x) + EPS
    totals = df.groupBy(*by).agg(F.sum(size).alias("_total"))
    p = size / F.col("_total")
    return df.join(totals, by).groupBy(*by).agg((-F.sum(p * F.log2(p + EPS))).alias("entropy"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; 0 where either is constant."""
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    a, b = x * both, y * both
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs of columns, in one pass over the rows; each pair is computed once."""
    at = {(a, b): f"_{i}" for i, (a, b) in enumerate((a, b) for k, a in enumerate(columns) for b in columns[k:])}
    one = df.agg(*[(F.when(F.stddev_pop(a) > 0, 1.0).otherwise(0.0) if a == b else correlation(F.col(a), F.col(b))).alias(name) for (a, b), name in at.items()])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(at.get((a, b)) or at[b, a]).alias("r")) for a in columns for b in columns]
    return one.select(F.inline(F.array(*rows)))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """mi in bits from equal-width bins; rows at the minimum of either column fall into no bin."""
    edges = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    place = lambda v, lo, hi: (F.ceil((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins) - 1).cast("int")
    cells = df.crossJoin(F.broadcast(edges)).select(place(x, "x0", "x1").alias("i"), place(y, "y0", "y1").alias("j")).where("i >= 0 AND j >= 0").groupBy("i", "j").count()
    p = cells.select("i", "j", F.col("count").alias("c"), F.sum("count").over(Window.partitionBy("i")).alias("ci"), F.sum("count").over(Window.partitionBy("j")).alias("cj"))
    total = cells.agg(F.sum("count").alias("n"))
    return p.crossJoin(F.broadcast(total)).agg(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mi"))


def histogram(df: DataFrame, by: list[str], x: str, edges: list[float]) -> DataFrame:
    """Cumulative counts at each upper edge and at infinity (le null), by labels."""
    counts = F.array(*[F.struct(F.lit(e).cast("double").alias("le"), F.count_if(F.col(x) <= e).alias("n")) for e in edges], F.struct(F.lit(None).cast("double").alias("le"), F.count(x).alias("n")))
    return df.groupBy(*by).agg(counts.alias("b")).select(*by, F.inline("b"))
