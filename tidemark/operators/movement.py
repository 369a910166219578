"""Movement: great-circle geometry and the chains of places that reports name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeops import seconds_between

EARTH_KM = 6371.0088


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north at the first point."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Signed smallest difference of two bearings, from -180 on."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def destination(lat: Column, lon: Column, towards: Column, km: Column) -> tuple[Column, Column]:
    d, t, a = km / EARTH_KM, F.radians(towards), F.radians(lat)
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = lon + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b)))
    return F.degrees(b), F.pmod(lon2 + 180, F.lit(360.0)) - 180


def in_sector(places: DataFrame, lat: float, lon: float, towards: float, half_angle: float, most_km: float, n: int) -> DataFrame:
    """The n places nearest to a point within a sector and a reach; ties by id."""
    at = F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")
    rows = places.withColumns({"km": distance_km(*at), "off": angle_between(bearing(*at), F.lit(towards))})
    return rows.where((F.col("km") > 0) & (F.col("km") <= most_km) & (F.abs("off") <= half_angle)).orderBy("km", "id").limit(n)


def segments(steps: DataFrame) -> DataFrame:
    """Of (event_id, id, at, location_id, independence_group): a row for each change of place along an event's reports,
    with the seconds since the report before and whether the two ends are independent."""
    order = Window.partitionBy("event_id").orderBy("at", "id")
    before = lambda c: F.lag(c).over(order)
    rows = steps.withColumns({"from_id": before("location_id"), "from_at": before("at"), "from_group": before("independence_group")})
    moved = rows.where(F.col("from_id").isNotNull() & (F.col("from_id") != F.col("location_id")))
    return moved.select("event_id", "id", "from_id", F.col("location_id").alias("to_id"), F.greatest(seconds_between(F.col("from_at"), F.col("at")).cast("long"), F.lit(0)).alias("seconds"), (F.col("from_group") != F.col("independence_group")).alias("independent"))


def extrapolated(segment_rows: DataFrame, minutes: float, most_kmh: float) -> DataFrame:
    """segments with coordinates (lat1, lon1, lat2, lon2, seconds) carried on in a straight line; why not, where not."""
    km = distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    kmh = F.when(F.col("seconds") > 0, km / (F.col("seconds") / 3600))
    why = F.when(km.isNull() | (km == 0), F.lit("no_leg")).when(kmh.isNull(), F.lit("no_elapsed")).when(kmh > most_kmh, F.lit("implausible_speed"))
    lat, lon = destination(F.col("lat2"), F.col("lon2"), bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), kmh * minutes / 60)
    return segment_rows.withColumns({"refused": why, "speed_kmh": kmh, "lat": F.when(why.isNull(), lat), "lon": F.when(why.isNull(), lon)})
