"""Scalar functions: rounding, shares, decay, trends, bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RISK_LEVELS = ((8.0, "critical"), (6.0, "high"), (4.0, "elevated"), (2.0, "guarded"))
EVIDENCE_LEVELS = ("unverified", "monitoring", "confirmed", "official")


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up at both sides of zero, unlike round()."""
    scale = F.lit(float(10**digits))
    return F.floor(x.cast("double") * scale + F.lit(0.5)) / scale


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_life(age: Column, half: float) -> Column:
    """2^(-age / half); negative ages count as zero."""
    return F.pow(F.lit(2.0), -F.greatest(age.cast("double"), F.lit(0.0)) / F.lit(half))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def trend(current: Column, previous: Column, band: float = 0.15) -> Column:
    """up or down beyond a relative dead band, new from nothing, else steady."""
    return (
        F.when((previous == 0) & (current > 0), F.lit("new"))
        .when(previous == 0, F.lit("steady"))
        .when((current - previous) / previous > band, F.lit("up"))
        .when((current - previous) / previous < -band, F.lit("down"))
        .otherwise(F.lit("steady"))
    )


def delta_percent(current: Column, previous: Column) -> Column:
    """Null where there is no base."""
    return F.when(previous > 0, rounded((current - previous) / previous * 100, 1))


def risk_level(score: Column) -> Column:
    out = F
    for floor, name in RISK_LEVELS:
        out = out.when(score >= floor, F.lit(name))
    return out.otherwise(F.lit("low"))


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Position of value in a fixed order from 0 on, null if it isn't there."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), value)
    return F.when(place > 0, (place - 1).cast("int"))


def clock_distance(a: Column, b: Column, size: int = 24) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(size) - d)


def poisson_at_least_one(rate: Column) -> Column:
    return 1 - F.exp(-rate)


def plural(count: Column, one: str, few: str, many: str) -> Column:
    """The Slavic choice among three forms."""
    ten, hundred = count % 10, count % 100
    return F.when((ten == 1) & (hundred != 11), F.lit(one)).when(ten.between(2, 4) & ~hundred.between(12, 14), F.lit(few)).otherwise(F.lit(many))
