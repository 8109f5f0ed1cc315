"""Selected segments as padded feature tensors with masks: Parquet by dataset, an npy export, a catalogue."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assemble(padded: DataFrame, rec: str = "rec_id") -> DataFrame:
    """A row for each recording from rows (rec, pos, mask, features): features (array of arrays), mask, num_segments. A recording's tensor is of fixed size."""
    rows = padded.groupBy(rec).agg(F.array_sort(F.collect_list(F.struct("pos", "mask", "features"))).alias("_r"))
    made = rows.select(rec, F.transform("_r", lambda x: x["features"]).alias("features"), F.transform("_r", lambda x: x["mask"].cast("tinyint")).alias("mask"))
    return made.withColumn("num_segments", F.aggregate("mask", F.lit(0), lambda a, m: a + m)).withColumn("feature_dim", F.size(F.col("features")[0]))


def write(tensors: DataFrame, path: str, dataset: str) -> None:
    tensors.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def read(spark: SparkSession, path: str, rec: str = "rec_id", ids: list | None = None) -> DataFrame:
    """All, or those of the ids: the filter reaches the scan."""
    out = spark.read.parquet(path)
    return out if ids is None else out.where(F.col(rec).isin(ids))


def catalogue(spark: SparkSession, path: str, rec: str = "rec_id") -> DataFrame:
    """Recordings, files and bytes of each dataset."""
    rows = spark.read.parquet(path).select("dataset", rec, "_metadata.file_path", "_metadata.file_size")
    files = rows.groupBy("dataset", "file_path").agg(F.max("file_size").alias("b"), F.count("*").alias("n"))
    return files.groupBy("dataset").agg(F.sum("n").alias("recordings"), F.count("*").alias("files"), F.sum("b").alias("bytes"), (F.sum("b") / (1 << 20)).alias("megabytes"))


def _npy(batches):
    import numpy as np
    import pandas as pd

    for frame in batches:
        out = []
        for x, m in zip(frame["features"], frame["mask"], strict=True):
            files = []
            for value in (np.array([list(r) for r in x], np.float32), np.array(list(m), np.uint8)):
                buffer = io.BytesIO()
                np.save(buffer, value)
                files.append(buffer.getvalue())
            out.append(files)
        yield pd.DataFrame({frame.columns[0]: frame.iloc[:, 0], "features_npy": [f[0] for f in out], "mask_npy": [f[1] for f in out]})


def to_npy(tensors: DataFrame, rec: str = "rec_id") -> DataFrame:
    """rec, features_npy and mask_npy: the bytes of .npy files, for any writer that the store needs."""
    kind = tensors.schema[rec].dataType.simpleString()
    return tensors.select(rec, "features", "mask").mapInPandas(_npy, f"{rec} {kind}, features_npy binary, mask_npy binary")
