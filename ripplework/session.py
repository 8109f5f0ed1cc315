"""Spark session with the settings that every entry point assumes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "ripplework", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one. On a cluster pass no master; keys in conf use "__" for "."."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("__", "."): value for key, value in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package where they couldn't otherwise: neither installed, nor on PYTHONPATH, nor in the working directory."""
    home = Path(__file__).resolve().parent.parent
    known = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if home in known or "site-packages" in home.parts or app in _SHIPPED:
        return
    file = Path(tempfile.mkdtemp(prefix="ripplework-")) / "ripplework.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted((home / "ripplework").rglob("*.py")):
            z.write(p, p.relative_to(home))
    spark.sparkContext.addPyFile(str(file))
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, local mode takes a temporary folder, and a cluster gets an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ripplework-')}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, most: int = 64 << 20) -> None:
    """Bound the bytes of recordings that a Python worker is handed at once; a longer one is a batch by itself. A lower bound of the caller's is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))
