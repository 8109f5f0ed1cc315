"""What the corpus operators share: table access, shared scratch tables, Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch handed to Python may hold.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: Folders of staged tables, by the `collected` blocks that are open.
_OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, so that further columns, whatever their names, can't clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once, in rows and in bytes; a longer row is a batch by itself.

    Plans read these settings when they run, after an operator has returned, so they stay; a lower bound of the
    caller's is kept.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, as in tests, local mode takes a temporary folder; a cluster, whose machines wouldn't share one, gets an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ripplework-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ripplework-{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    for made in _OPEN:
        made.append(path)
    back = spark.read.schema(schema).parquet(path)
    back.staged_at = path
    return back


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getParent()  # the folder that scratch has made for it
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if folder := getattr(df, "staged_at", None):
            _delete(spark, folder)


@contextmanager
def collected(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is staged within the block, but for the tables that the block puts into the list it is given."""
    made: list[str] = []
    keep: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.pop()
    for folder in set(made) - {df.staged_at for df in keep}:
        _delete(spark, folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it (a lambda variable, which the optimizer can't inline)."""
    return F.transform(F.array(value), body)[0]
