"""Queries for manifests, predicates, strings, sets and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions import text
from ripplework.operators import joins
from ripplework.plans.registry import query, round_all
from ripplework.sources import manifests, signals

# orders stand for recordings, their lines for results of extractors
_RESULTS = """results AS (SELECT o_orderkey AS video_id, concat('extractor_', l_linenumber) AS name, l_returnflag <> 'R' AS success, l_quantity AS value, l_discount AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.table(spark, sf_dir, "lineitem").join(signals.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    ok = F.col("l_returnflag") != "R"
    return rows.select(
        F.col("l_orderkey").alias("video_id"), F.concat(F.lit("extractor_"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("1.0").alias("version"), ok.alias("success"),
        F.create_map(F.lit("value"), F.col("l_quantity")).alias("payload"), F.when(~ok, "rejected").alias("error"), F.col("l_discount").alias("processing_time"),
    )


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, 'tpch' AS dataset, string_agg(name, ',' ORDER BY name) AS names, count(*) FILTER (success) AS succeeded, round(sum(seconds) + 1e-9, 6) AS seconds, concat('tpch/manifests/', video_id, '.json') AS uri FROM results GROUP BY video_id", _RESULTS)
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.build(_results(spark, sf_dir), "tpch")
    names = F.array_join(F.transform("extractors", lambda e: e["name"]), ",")
    return round_all(m.select("video_id", "dataset", names.alias("names"), F.size(F.filter("extractors", lambda e: e["success"])).cast("long").alias("succeeded"), F.col("total_processing_time").alias("seconds"), F.col("manifest_uri").alias("uri")), "seconds")


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, name, success, value FROM results", _RESULTS)
def manifest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.results(manifests.build(_results(spark, sf_dir), "tpch"))
    return rows.select("video_id", "name", "success", F.col("payload")["value"].alias("value"))


@query("SELECT video_id, max(value) FILTER (name = 'extractor_1' AND success) AS first_value, max(value) FILTER (name = 'extractor_2' AND success) AS second_value FROM results GROUP BY video_id", _RESULTS)
def feature_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.features(_results(spark, sf_dir), {"first_value": ("extractor_1", "value"), "second_value": ("extractor_2", "value")})


@query("SELECT name, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(sum(seconds) + 1e-9, 4) AS seconds, round(avg(seconds) + 1e-9, 6) AS mean_seconds FROM results GROUP BY GROUPING SETS ((name), ())", _RESULTS)
def success_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(round_all(manifests.totals(_results(spark, sf_dir)), "seconds", 4), "mean_seconds")


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, max(value) FILTER (name = 'extractor_3') AS third FROM results GROUP BY video_id", _RESULTS)
def manifest_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _results(spark, sf_dir).groupBy("video_id", "name").agg(F.create_map(F.lit("value"), F.max(F.col("payload")["value"])).alias("payload"), F.max("success").alias("success"), F.max("processing_time").alias("processing_time"))
    m = manifests.as_map(manifests.build(one, "tpch"))
    return m.select("video_id", F.try_element_at(F.try_element_at("payloads", F.lit("extractor_3")), F.lit("value")).alias("third"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), -1) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "events").select("event_id", text.json_number(F.col("props"), "$.k", -1.0).alias("k"))


_PROBE = "concat('{\"format\": {\"duration\": \"', l_quantity, '\", \"size\": \"', l_partkey, '\"}, \"streams\": [{\"codec_type\": \"video\", \"codec_name\": \"h264\", \"r_frame_rate\": \"', l_suppkey, '/', l_linenumber - 1, '\"}]}')"


@query("SELECT l_orderkey, l_linenumber, l_quantity AS duration, l_partkey AS size, 0::BIGINT AS bit_rate, 'h264' AS video_codec, NULL::VARCHAR AS audio_codec, round(CASE WHEN l_linenumber > 1 THEN l_suppkey / (l_linenumber - 1) ELSE 0 END + 1e-9, 6) AS fps FROM lineitem")
def media_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", manifests.media_info(F.expr(_PROBE)).alias("m"))
    return round_all(rows.select("l_orderkey", "l_linenumber", "m.*"), "fps")


_URLS = "SELECT url FROM pages"


@query("SELECT page_id, lower(url) LIKE '%.wav' OR lower(url) LIKE '%.mp3' OR lower(url) LIKE '%.flac' OR url LIKE '/%' OR url LIKE 's3://%' AS valid, regexp_extract(replace(replace(url, 'https://', 's3://'), 'http://', 's3://'), '^s3://([^/]+)/?(.*)$', 1) AS bucket, regexp_extract(replace(replace(url, 'https://', 's3://'), 'http://', 's3://'), '^s3://([^/]+)/?(.*)$', 2) AS key FROM pages")
def uri_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    bucket, key = signals.parse_s3(F.regexp_replace(url, "^https?://", "s3://"))
    return signals.table(spark, sf_dir, "pages").select("page_id", signals.valid_uri(url).alias("valid"), bucket.alias("bucket"), key.alias("key"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_.') AS safe, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("safe"), text.basename(F.col("url")).alias("base"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ', printf('%.1fs', s % 60)) ELSE concat(CAST(floor(s / 3600) AS BIGINT), 'h ', CAST(floor((s % 3600) / 60) AS BIGINT), 'm ', printf('%.1fs', s % 60)) END AS duration, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size FROM (SELECT o_orderkey, floor(o_totalprice) / 10 AS s, CAST(o_orderkey * 1000 + 1 AS DOUBLE) AS b FROM orders)")
def format_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "orders").select("o_orderkey", text.format_duration(F.floor("o_totalprice") / 10).alias("duration"), text.format_size((F.col("o_orderkey") * 1000 + 1).cast("double")).alias("size"))


@query("SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') AS iso FROM events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "events").select("event_id", text.iso_utc(F.col("ts")).alias("iso"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = signals.table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    return events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 60 MINUTES")).select("event_id")


@query("SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS argmax, round(list_sum(e[1:8]) + 1e-9, 5) AS eighth_sum, round(e[63] + 1e-9, 6) AS rotated_first, CAST(len(e) AS INTEGER) AS n FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = signals.table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    out = rows.select("vec_id", text.argmax(F.col("e")).alias("argmax"), F.element_at(text.running_sum(F.col("e")), 8).alias("eighth_sum"), text.rotate(F.col("e"), 2)[0].alias("rotated_first"), F.size("e").alias("n"))
    return round_all(round_all(out, "eighth_sum", 5), "rotated_first")


@query("SELECT vec_id, round(y[1] + 1e-9, 6) AS first, round(y[70] + 1e-9, 6) AS last, CAST(len(y) AS INTEGER) AS n, round(m + 1e-9, 6) AS mono, true AS shaped FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) AS y, (CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE)) / 2 AS m FROM embeddings)")
def mono_and_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = signals.table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    fitted, pair = signals.fit_length(F.col("e"), 70), F.array(F.col("e"), F.reverse("e"))
    out = rows.select("vec_id", fitted[0].alias("first"), fitted[69].alias("last"), F.size(fitted).alias("n"), signals.to_mono(pair)[0].alias("mono"), signals.has_shape(pair, 2).alias("shaped"))
    return round_all(out, "first last mono")


@query("SELECT DISTINCT name FROM (VALUES ('pitch'), ('spectral_extractor'), ('none_such'), ('mfcc')) AS v(name) WHERE name IN ('none_such', 'mfcc')")
def unknown_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.plans.extractors import registry

    asked = spark.createDataFrame([("pitch",), ("spectral_extractor",), ("none_such",), ("mfcc",)], "name string")
    return joins.unknown(asked, registry(spark))


@query("SELECT count(*) AS n FROM (VALUES (1)) AS v(x), range(22)")
def extractor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.plans.extractors import registry

    return registry(spark).agg(F.count("*").alias("n"))


@query("SELECT event_type FROM events WHERE value > 400 INTERSECT SELECT event_type FROM events WHERE value < 1")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signals.table(spark, sf_dir, "events")
    return e.where("value > 400").select("event_type").intersect(e.where("value < 1").select("event_type"))


@query("SELECT user_id, event_type, count(*) AS queued FROM events GROUP BY user_id, event_type")
def queue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("queued"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false WHEN o_orderkey % 3 = 1 THEN true ELSE false END AS valid FROM orders")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = signals.table(spark, sf_dir, "orders").select("o_orderkey", k.cast("string").alias("video_id"), F.when(k % 3 == 0, "").otherwise("a.wav").alias("audio_uri"), F.when(k % 3 == 2, "v.mp4").alias("video_uri"))
    return manifests.valid_request(rows).select("o_orderkey", "valid")


@query("SELECT user_id, hour, CASE WHEN load > 400 THEN 'scale_up' WHEN load < 20 THEN 'scale_down' ELSE 'keep' END AS action FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS hour, max(value) AS load FROM events GROUP BY ALL)")
def scaling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplework.streaming.streams import scaling_action

    day = signals.table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("hour")).agg(F.max("value").alias("load"))
    return day.select("user_id", "hour", scaling_action(F.col("load"), 400.0, 20.0).alias("action"))
