"""The batch operators on streams: windows, sessions and runs with bounded state.

Semantics: event time, a watermark of one segment, append mode; a window's or session's row comes once the
watermark has passed it. Under availableNow, over data without rows behind the watermark, the results equal the
batch ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single one; ts becomes a timestamp. Batches close by files (and by the writer's trigger)."""
    source = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        source, path = source.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return source.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "3 days", hop: str = "36 hours", late: str = "3 days") -> DataFrame:
    """Statistics of epoch-aligned sliding windows by user."""
    window = F.window("ts", length, hop)
    one = events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"))
    return one.select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std", "max")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "3 days") -> DataFrame:
    """Clusters of a user's events that follow each other within the gap."""
    one = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("size"), F.sum("value").alias("total"))
    return one.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "size", "total")


RUN = "user_id long, label string, start timestamp, end timestamp, n long"
HELD = "label string, start long, end long, n long, times array<long>, ids array<long>, labels array<string>"


def label_runs(events: DataFrame, label: str = "event_type", late: str = "3 days", idle_days: int = 365) -> DataFrame:
    """Runs of an equal label by user, whatever the order in which rows come, as long as they aren't behind the watermark.

    State is a user's open run, and its rows that the watermark hasn't passed yet: these wait, so that a row that
    comes late finds its place. A run is emitted when a row with another label has joined the order, or when the
    watermark is `idle_days` beyond its last row; a later row begins another run then.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        *run, times, ids, labels = state.get if state.exists else (None, 0, 0, 0, [], [], [])
        waiting = list(zip(times, ids, labels, strict=True))
        for frame in [] if state.hasTimedOut else frames:
            micros = frame["ts"].astype("datetime64[us, UTC]" if frame["ts"].dt.tz else "datetime64[us]").astype("int64")
            waiting += zip(micros.tolist(), frame["event_id"].tolist(), frame[label].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        stamp = lambda us: pd.Timestamp(us, unit="us", tz="UTC")

        def close() -> None:
            if run[3]:
                out.append((key[0], run[0], stamp(run[1]), stamp(run[2]), run[3]))
            run[3] = 0

        for at, _, name in sorted((x for x in waiting if x[0] <= passed), key=lambda x: x[:2]):
            if run[3] and run[0] == name:
                run[2], run[3] = at, run[3] + 1
            else:
                close()
                run = [name, at, at, 1]
        waiting = sorted((x for x in waiting if x[0] > passed), key=lambda x: x[:2])
        idle = idle_days * 86_400_000_000
        if run[3] and not waiting and passed > run[2] + idle:
            close()
        if run[3] or waiting:
            times, ids, labels = (list(x) for x in zip(*waiting, strict=True)) if waiting else ([], [], [])
            state.update((*run, times, ids, labels))
            state.setTimeoutTimestamp(max((times[0] if times else run[2] + idle) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "label", "start", "end", "n"])

    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id").applyInPandasWithState(step, RUN, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def scaling_action(load: Column, high: float, low: float) -> Column:
    """What a worker pool should do under a load."""
    return F.when(load > high, "scale_up").when(load < low, "scale_down").otherwise("keep")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, exactly once, into Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each micro-batch into a folder of its own that a retry replaces: the sink stays right if a batch runs twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_end(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """All rows of an append-mode result over a folder (or file) that gets no more rows.

    What is there is read as a stream; then one row of a far later time, without a user, moves the watermark past
    everything, so that all windows, sessions and runs are closed. State stays bounded by the watermark throughout.
    """
    rows = spark.read.parquet(path)
    far = [(F.lit("2200-01-01") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    last = spark.range(1).select(*far)
    last.limit(0).write.parquet(f"{out}-end")
    for _ in range(2):
        stream = read(spark, path).unionByName(read(spark, f"{out}-end", rows.schema))
        write(build(stream), out, f"{out}-checkpoint")
        last.coalesce(1).write.mode("append").parquet(f"{out}-end")
    return spark.read.parquet(out).where("user_id IS NOT NULL")
