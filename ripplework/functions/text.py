"""Strings, times and nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def safe_filename(name: Column) -> Column:
    """Reserved characters as one underscore; none of these or dots at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), "_+", "_"), r"^[_.]+|[_.]+$", "")


def format_duration(seconds: Column) -> Column:
    h, m = F.floor(seconds / 3600).cast("int"), F.floor((seconds % 3600) / 60).cast("int")
    rest = F.format_string("%.1fs", seconds % 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), rest)).otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), rest))


def format_size(size: Column) -> Column:
    out = F.when(size < 1024, F.format_string("%.1f B", size.cast("double")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(size < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", size / 1024.0**i))
    return out.otherwise(F.format_string("%.1f PB", size / 1024.0**5))


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def json_number(json: Column, path: str, default: float | None = None) -> Column:
    found = F.get_json_object(json, path).cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def rotate(x: Column, n: int) -> Column:
    """The array turned by n places to the right."""
    k = F.size(x) - F.pmod(F.lit(n), F.size(x))
    return F.concat(F.slice(x, k + 1, F.size(x) - k), F.slice(x, 1, k))


def running_sum(x: Column) -> Column:
    """Sums of an array's beginnings."""
    return F.aggregate(x, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + v)))


def argmax(x: Column) -> Column:
    """Place, from 0, of the first largest element."""
    return F.array_position(x, F.array_max(x)) - 1
