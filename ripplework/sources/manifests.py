"""Manifests: one nested row for each recording, with the results of its extractors; and where they are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, MapType, StringType, StructField, StructType

RESULT = StructType([
    StructField("name", StringType()), StructField("version", StringType()), StructField("success", BooleanType()), StructField("payload", MapType(StringType(), DoubleType())),
    StructField("error", StringType()), StructField("processing_time", DoubleType()),
])
MANIFEST = StructType([
    StructField("video_id", StringType()), StructField("task_id", StringType()), StructField("dataset", StringType()), StructField("timestamp", StringType()), StructField("extractors", ArrayType(RESULT)),
    StructField("schema_version", StringType()), StructField("total_processing_time", DoubleType()), StructField("manifest_uri", StringType()),
])
VERSION = "audio_manifest_v1"
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
MEDIA = "format STRUCT<duration: STRING, size: STRING, bit_rate: STRING, format_name: STRING>, streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, r_frame_rate: STRING, sample_rate: STRING, channels: INT>>"


def build(results: DataFrame, dataset: str, task: str | None = None) -> DataFrame:
    """Manifests from rows (video_id, name, version, success, payload, error, processing_time), results in order of name."""
    one = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT.fields])
    rows = results.groupBy("video_id").agg(F.collect_list(one).alias("extractors"), F.sum("processing_time").alias("total_processing_time"))
    ordered = F.array_sort("extractors", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return rows.select(
        F.col("video_id").cast("string").alias("video_id"), F.lit(task).cast("string").alias("task_id"), F.lit(dataset).alias("dataset"), F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
        ordered.alias("extractors"), F.lit(VERSION).alias("schema_version"), "total_processing_time", F.concat(F.lit(f"{dataset}/manifests/"), F.col("video_id").cast("string"), F.lit(".json")).alias("manifest_uri"),
    )


def write(manifests: DataFrame, path: str) -> None:
    """JSON by dataset; a rerun replaces the datasets that it has."""
    manifests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def results(manifests: DataFrame) -> DataFrame:
    """A row for each extractor of each manifest."""
    return manifests.select("video_id", "dataset", F.inline("extractors"))


def as_map(manifests: DataFrame) -> DataFrame:
    """extractors as a map from name to payload; of a name that occurs twice the last counts."""
    pairs = F.transform("extractors", lambda e: F.struct(e["name"], e["payload"]))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return manifests.select("video_id", F.map_from_entries(last).alias("payloads"))


def features(found: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """A column for each field, renamed: column -> (extractor, field); null where it is missing."""
    pick = lambda name, field: F.max(F.when((F.col("name") == name) & F.col("success"), F.try_element_at("payload", F.lit(field))))
    return found.groupBy("video_id").agg(*[pick(*source).alias(column) for column, source in mapping.items()])


def totals(found: DataFrame) -> DataFrame:
    """Counts of results, successes and failures, total and mean time, by extractor and over all (name null)."""
    return found.groupingSets([["name"], []], "name").agg(
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.sum("processing_time").alias("seconds"), F.avg("processing_time").alias("mean_seconds"),
    )


def media_info(json: Column) -> Column:
    """duration, size, bit_rate, video_codec, audio_codec and fps of a probe's JSON; zeros and nulls where it lacks them."""
    probe = F.from_json(json, MEDIA)
    stream = lambda kind: F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == kind), 0)
    rate = stream("video")["r_frame_rate"]
    number = lambda c, t: F.coalesce(c.try_cast(t), F.lit(0).cast(t))
    parts = F.split(rate, "/")
    return F.struct(
        number(probe["format"]["duration"], "double").alias("duration"), number(probe["format"]["size"], "bigint").alias("size"), number(probe["format"]["bit_rate"], "bigint").alias("bit_rate"),
        stream("video")["codec_name"].alias("video_codec"), stream("audio")["codec_name"].alias("audio_codec"),
        F.coalesce(F.when(F.get(parts, 1).try_cast("double") > 0, F.get(parts, 0).try_cast("double") / F.get(parts, 1).try_cast("double")), F.lit(0.0)).alias("fps"),
    )


def valid_request(rows: DataFrame) -> DataFrame:
    """valid: a video_id, and one of audio_uri and video_uri."""
    given = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return rows.withColumn("valid", given("video_id") & (given("audio_uri") != given("video_uri")))
