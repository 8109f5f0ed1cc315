"""A stream that is read to its end gives what the batch operators give."""

import datetime
import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplework.operators import sequence
from ripplework.streaming import streams


def events(spark, sf_dir, tmp_path):
    """Events in files that follow each other in time, and one far later row that closes everything."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 8")
    place = F.ntile(3).over(Window.orderBy("ts"))
    rows = source.withColumn("part", place)
    last = source.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.expr("timestamp'2100-01-01'").alias("ts"), F.lit(-1).cast("long").alias("user_id"), *source.columns[3:]).withColumn("part", F.lit(4))
    for k in (1, 2, 3, 4):
        rows.unionByName(last).where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return source, streams.read(spark, str(tmp_path / "in"), files_per_trigger=1)


def run(spark, stream, tmp_path, name):
    streams.write(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    return spark.read.parquet(str(tmp_path / name)).where("user_id >= 0")


def test_windows(spark, sf_dir, tmp_path):
    source, stream = events(spark, sf_dir, tmp_path)
    got = run(spark, streams.windowed(stream), tmp_path, "out")
    want = streams.windowed(source)
    key = lambda df: sorted((r.user_id, r.start, r.n, round(r.mean, 9)) for r in df.collect())
    assert key(got) == key(want) and got.count() > 0


def test_sessions(spark, sf_dir, tmp_path):
    source, stream = events(spark, sf_dir, tmp_path)
    got = run(spark, streams.sessions(stream), tmp_path, "out")
    key = lambda df: sorted((r.user_id, r.start, r["size"], round(r.total, 6)) for r in df.collect())
    assert key(got) == key(streams.sessions(source)) and got.count() > 0


def test_label_runs(spark, sf_dir, tmp_path):
    source, stream = events(spark, sf_dir, tmp_path)
    got = run(spark, streams.label_runs(stream), tmp_path, "out")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    batch = sequence.label_runs(source.withColumn("frame", order), "event_type", rec="user_id", t="ts")
    assert sorted((r.user_id, r.label, r.start, r.n) for r in got.collect()) == sorted((r.user_id, r.label, r.start, r.frames) for r in batch.collect())


def test_label_runs_out_of_order(spark, tmp_path):
    """Rows that come in later batches than their neighbours, but not behind the watermark, find their place."""
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), i % 2, r.choice("xy")) for i in range(200)] + [(900, start + datetime.timedelta(days=9), 7, "x"), (901, start + datetime.timedelta(days=60), 7, "x")]
    late = sorted(rows, key=lambda x: x[1] + datetime.timedelta(hours=r.uniform(0, 70)))
    for k in range(0, len(late), 20):
        spark.createDataFrame(late[k : k + 20], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), files_per_trigger=1)
    out, end = str(tmp_path / "out"), str(tmp_path / "out-checkpoint")
    streams.write(streams.label_runs(stream), out, end)
    got = streams.to_end(spark, str(tmp_path / "in"), streams.label_runs, str(tmp_path / "whole"))
    want = []
    for user in (0, 1, 7):
        for name, group in itertools.groupby(((t, x) for _, t, u, x in rows if u == user), key=lambda x: x[1]):
            times = [t for t, _ in group]
            want.append((user, name, times[0], times[-1], len(times)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    emitted = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert set(emitted) <= set(want) and len(emitted) > 50  # what is left waits for the watermark


def test_upsert_replaces_a_batch(spark, sf_dir, tmp_path):
    source, stream = events(spark, sf_dir, tmp_path)
    streams.upsert(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0").count() == source.count()
