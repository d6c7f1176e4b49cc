"""Dates, intervals and numbers in other bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(secs: Column) -> Column:
    return F.timestamp_micros((secs.cast("double") * 1_000_000).cast("long")).cast("timestamp_ntz")


def meta_date(meta: Column, last_updated: Column) -> Column:
    """The day of a timestamp or date in JSON, else the source's own."""
    stamp = F.substring(F.get_json_object(meta, "$.timestamp"), 1, 10)
    return F.coalesce(F.try_to_date(stamp), F.try_to_date(F.get_json_object(meta, "$.date")), last_updated.cast("date"))


def archive_stamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def mail_date(text: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008``."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss xx yyyy"))


def interval_seconds(text: Column) -> Column:
    """Seconds of ``D days, H:MM:SS.f``; null where it is none."""
    pattern = r"^\s*(?:(-?\d+) days?,\s*)?(\d+):(\d\d):(\d\d(?:\.\d+)?)\s*$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def elapsed(secs: Column) -> Column:
    return F.format_string("%d:%02d:%05.2f", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def mean_angle(a: Column, b: Column) -> Column:
    """Angle between two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))))
