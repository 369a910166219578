"""Instants and local time. Sessions run in UTC; local buckets are taken of the local wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from ..params import LOCAL_ZONE, AnalyticsWindow


def instant(at: datetime) -> Column:
    return F.lit(at).cast("timestamp")


def within(ts: Column, start: datetime, end: datetime) -> Column:
    """start <= ts < end."""
    return (ts >= instant(start)) & (ts < instant(end))


def local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_bucket(ts: Column, bucket: str, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.date_trunc(bucket, local(ts, zone)))


def local_hour(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.hour(local(ts, zone))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def age_days(ts: Column, as_of: datetime) -> Column:
    return seconds_between(ts, instant(as_of)) / 86400


def epoch_bucket(ts: Column, minutes: int) -> Column:
    size = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / size) * size)


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def wall_to_instant(wall: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(wall, zone)


def in_window(window: AnalyticsWindow, ts: str = "published_at") -> Column:
    """The scan predicate of the archive: the half-open range, and versions and class where they are asked for."""
    out = within(F.col(ts), window.start, window.end)
    if window.versions is not None:
        out = out & F.col("classifier_version").isin(*window.versions)
    if window.threat_type is not None:
        out = out & (F.col("threat_type") == window.threat_type)
    return out
