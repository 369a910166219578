"""Parameters of the analyses: half-open windows resolved in Python, passed to plans as literals."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

LOCAL_ZONE = "Europe/Kyiv"
DEFAULT_DAYS, MOST_DAYS, MOST_ROWS = 30, 400, 1000
IDENTIFIER = re.compile(r"[A-Za-z0-9_.:-]{1,64}")


@dataclass(frozen=True)
class AnalyticsWindow:
    """[start, end) with optional versions, class and region; buckets are local days, weeks or months."""

    start: datetime
    end: datetime
    bucket: str
    versions: tuple[str, ...] | None = None
    threat_type: str | None = None
    region_id: str | None = None
    limit: int = 200
    zone: str = LOCAL_ZONE

    @classmethod
    def resolve(cls, as_of: datetime, start: datetime | None = None, end: datetime | None = None, bucket: str | None = None, **rest) -> AnalyticsWindow:
        end = end or as_of
        start = start or end - timedelta(days=DEFAULT_DAYS)
        if not start < end:
            raise ValueError("the window is empty")
        days = (end - start) / timedelta(days=1)
        if days > MOST_DAYS:
            raise ValueError(f"the window is longer than {MOST_DAYS} days")
        bucket = bucket or ("month" if days > 120 else "week" if days > 35 else "day")
        if bucket not in ("day", "week", "month"):
            raise ValueError("bucket is day, week or month")
        if not 1 <= rest.get("limit", 1) <= MOST_ROWS:
            raise ValueError(f"limit is from 1 to {MOST_ROWS}")
        for name in (*(rest.get("versions") or ()), rest.get("threat_type") or "x", rest.get("region_id") or "x"):
            if not IDENTIFIER.fullmatch(name):
                raise ValueError(f"not an identifier: {name!r}")
        return cls(start, end, bucket, **rest)

    @property
    def previous_start(self) -> datetime:
        return self.start - (self.end - self.start)


#: Days and bucket minutes of each period.
PERIODS = {"day": (1, 5), "week": (7, 15), "month": (31, 30)}


@dataclass(frozen=True)
class PeriodWindow:
    """A period up to as_of, and the adjacent one of the same length before it."""

    period: str
    start: datetime
    end: datetime
    previous_start: datetime
    bucket_minutes: int

    @classmethod
    def resolve(cls, period: str, as_of: datetime) -> PeriodWindow:
        days, minutes = PERIODS[period]
        span = timedelta(days=days)
        return cls(period, as_of - span, as_of, as_of - 2 * span, minutes)


@dataclass(frozen=True)
class TacticsWindows:
    """The current day and the disjoint baseline before it."""

    current_start: datetime
    current_end: datetime
    baseline_start: datetime
    baseline_days: int = 14

    @classmethod
    def resolve(cls, as_of: datetime) -> TacticsWindows:
        start = as_of - timedelta(hours=24)
        return cls(start, as_of, start - timedelta(days=14))


def hour_band(band: str, as_of: datetime, zone: str = LOCAL_ZONE) -> list[int]:
    """Local hours of a band: night 22-06, day 06-22, or the twelve hours from as_of on."""
    if band == "night":
        return [22, 23, 0, 1, 2, 3, 4, 5]
    if band == "day":
        return list(range(6, 22))
    if band == "next12h":
        first = as_of.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).hour
        return [(first + i) % 24 for i in range(12)]
    raise ValueError(f"no such band: {band}")
