"""Vectors: statistics, scaling, compression by principal components, and the interface for models that make them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def vector_stats(df: DataFrame, rec: str = "rec_id", embedding: str = "embedding") -> DataFrame:
    """mean, std, min, max, l2, abs_mean, abs_std, energy, sparsity, entropy (nats) of each vector, within its row: no shuffle."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = df.select(rec, x.alias("_x")).withColumn("_a", F.transform("_x", F.abs)).withColumn("_n", F.size("_x"))
    rows = rows.withColumns({"mean": total(F.col("_x")) / F.col("_n"), "abs_mean": total(F.col("_a")) / F.col("_n"), "energy": total(F.transform("_x", lambda v: v * v)), "_t": total(F.col("_a"))})
    spread = lambda a, m: F.sqrt(total(F.transform(a, lambda v: (v - F.col(m)) * (v - F.col(m)))) / F.col("_n"))
    return rows.select(
        rec, "mean", spread("_x", "mean").alias("std"), F.array_min("_x").alias("min"), F.array_max("_x").alias("max"), F.sqrt("energy").alias("l2"), "abs_mean", spread("_a", "abs_mean").alias("abs_std"), "energy",
        (F.size(F.filter("_a", lambda v: v < 1e-6)) / F.col("_n")).alias("sparsity"),
        F.when(F.col("_t") > 0, -total(F.transform("_a", lambda v: v / F.col("_t") * F.ln(v / F.col("_t") + 1e-10)))).otherwise(0.0).alias("entropy"),
    )


def time_mean(df: DataFrame, rec: str = "rec_id", embedding: str = "embedding") -> DataFrame:
    """The element-wise mean of each recording's vectors, in long form: rec, pos, v."""
    return df.select(rec, F.posexplode(embedding).alias("pos", "v")).groupBy(rec, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))


def as_arrays(long: DataFrame, rec: str = "rec_id") -> DataFrame:
    rows = long.groupBy(rec).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_a"))
    return rows.select(rec, F.transform("_a", lambda s: s["v"]).alias("embedding"))


def zscores(long: DataFrame, group: list[str] | None = None) -> DataFrame:
    """z of each value against its position's mean and population deviation (0 deviation: 0). The few statistics are joined, vectors aren't gathered."""
    keys = [*(group or []), "pos"]
    stats = long.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return long.join(stats, keys).withColumn("z", F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


class Compressor:
    """Scales vectors (population deviation) and keeps their first principal components, one model for each kind of vector."""

    def __init__(self, dims: dict[str, int]):
        self.dims = dims
        self.models: dict[str, tuple] = {}

    def fit(self, vectors: DataFrame, kind: str = "kind", embedding: str = "embedding") -> Compressor:
        """Kinds without rows, and unknown ones, are skipped."""
        for name, dim in self.dims.items():
            rows = vectors.where(F.col(kind) == name).select(array_to_vector(F.transform(embedding, lambda v: v.cast("double"))).alias("v"))
            shape = rows.agg(F.count("*").alias("n"), F.max(F.size(vector_to_array("v"))).alias("d")).first()
            if not shape.n:
                continue
            scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(rows)
            k = min(dim, shape.d)
            factor = float(np.sqrt(shape.n / (shape.n - 1))) if shape.n > 1 else 1.0  # the scaler divides by n - 1
            model = PCA(k=k, inputCol="s", outputCol="p").fit(scaler.transform(rows))
            self.models[name] = (scaler, model, factor)
        return self

    def transform(self, vectors: DataFrame, kind: str = "kind", embedding: str = "embedding") -> DataFrame:
        """With pca, an array; null for kinds that no model was fitted for."""
        parts = []
        for name, (scaler, model, factor) in self.models.items():
            rows = vectors.where(F.col(kind) == name).withColumn("v", array_to_vector(F.transform(embedding, lambda v: v.cast("double"))))
            made = model.transform(scaler.transform(rows))
            parts.append(made.withColumn("pca", F.transform(vector_to_array("p"), lambda v: v * F.lit(factor))).drop("v", "s", "p"))
        rest = vectors.where(~F.coalesce(F.col(kind).isin(*self.models), F.lit(False))).withColumn("pca", F.lit(None).cast("array<double>"))
        out = rest
        for part in parts:
            out = out.unionByName(part)
        return out

    def explained(self) -> dict[str, list[float]]:
        return {name: model.explainedVariance.toArray().tolist() for name, (_, model, _) in self.models.items()}

    def save(self, path: str) -> None:
        for name, (scaler, model, _) in self.models.items():
            scaler.write().overwrite().save(f"{path}/{name}/scaler")
            model.write().overwrite().save(f"{path}/{name}/pca")
        spark = SparkSession.active()
        rows = [(name, dim, self.models[name][2] if name in self.models else None) for name, dim in self.dims.items()]
        spark.createDataFrame(rows, "kind string, dim int, factor double").coalesce(1).write.mode("overwrite").parquet(f"{path}/dims")

    @classmethod
    def load(cls, path: str) -> Compressor:
        """What `save` has written: it transforms as the saved one did."""
        rows = SparkSession.active().read.parquet(f"{path}/dims").collect()
        made = cls({r.kind: r.dim for r in rows})
        made.models = {r.kind: (StandardScalerModel.load(f"{path}/{r.kind}/scaler"), PCAModel.load(f"{path}/{r.kind}/pca"), r.factor) for r in rows if r.factor is not None}
        return made

    @staticmethod
    def load_pca(path: str, name: str) -> PCAModel:
        return PCAModel.load(f"{path}/{name}/pca")


Model = Callable[[np.ndarray], np.ndarray]


def embed(samples: DataFrame, load: Callable[[], Model], rec: str = "rec_id") -> DataFrame:
    """rec, embedding, error of arrays of samples (rec, x), by a model that `load` makes once in each Python worker; a row that fails has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            rows = []
            for name, x in zip(frame[rec], frame["x"], strict=True):
                try:
                    rows.append((name, [float(v) for v in model(np.asarray(x, np.float64))], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[rec, "embedding", "error"])

    kind = samples.schema[rec].dataType.simpleString()
    return samples.select(rec, "x").mapInPandas(run, f"{rec} {kind}, embedding array<float>, error string")


def stub(dim: int = 512, seed: int = 42) -> Callable[[], Model]:
    """A deterministic stand-in where no trained model is at hand: normal numbers of deviation 0.1."""
    return lambda: lambda x: np.random.default_rng(seed).normal(0, 0.1, dim)
