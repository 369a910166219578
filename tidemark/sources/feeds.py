"""JSON feeds as rows: alert snapshots of several shapes, nested region feeds, GeoJSON layers, hierarchical code lists.

Bodies are text columns, one body a row, parsed by from_json with explicit types, so a feed that was fetched a million
times is a million rows of a table and never a document on the driver. A body that isn't JSON gives no rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeops import instant

#: Names that providers give to the same thing, the first one present counts.
KEY_NAMES = ("locationId", "regionId", "region_id")
NAME_NAMES = ("locationName", "regionName", "region_name")
TYPE_NAMES = ("alertType", "type", "alert_type")
START_NAMES = ("startedAt", "started_at", "start", "lastUpdate")
ACTIVE_NAMES = ("active", "isActive", "is_active")
NESTED_NAMES = ("activeAlerts", "active_alerts", "alarms", "alerts")
ROOT_NAMES = ("states", "alerts", "data")
ACTIVE_WORDS = ("active", "ongoing", "true", "1")


def _first(body: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(body, f"$.{n}") for n in names))


def _array(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; null if it is none."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _objects(texts: Column, names: tuple[str, ...]) -> Column:
    """Each of the JSON texts as a struct of these fields, strings all, in one pass over it; null for what is no object."""
    return F.transform(texts, lambda x: F.when(x.startswith("{"), F.from_json(x, ", ".join(f"`{n}` string" for n in names))))


#: What an alert may say, and a region beside its own alert.
ALERT_FIELDS = (*KEY_NAMES, "id", *NAME_NAMES, "name", *TYPE_NAMES, *START_NAMES, *ACTIVE_NAMES, "status", "parentName", "parent_name")


def alert_snapshot(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """bodies with location_key, location_name, parent_name, alert_type, active, started_at and external_id: a row for each
    alert of each region. The root is an array, or an object that has one under a known name; a region may hold alerts of its
    own, which count as active unless they say otherwise. Of a field that comes twice in an object the last one counts."""
    body = F.col(body_col)
    # outer generators: an inner one has the optimiser ask below it whether there are any elements, and so parse them twice
    root = F.get(_objects(F.array(F.ltrim(body)), ROOT_NAMES), F.lit(0))
    rooted = bodies.withColumn("_root", root).withColumn("_rows", F.coalesce(_array(body), *(_array(F.col("_root")[n]) for n in ROOT_NAMES)))
    regions = rooted.select(*bodies.columns, F.posexplode_outer(_objects(F.col("_rows"), (*ALERT_FIELDS, *NESTED_NAMES))).alias("_i", "_region")).where(F.col("_region").isNotNull())
    regions = regions.withColumn("_nested", F.coalesce(*(_array(F.col("_region")[n]) for n in NESTED_NAMES)))
    own = F.array(F.struct(*(F.col("_region")[n].alias(n) for n in ALERT_FIELDS)))
    alerts = regions.select(*bodies.columns, "_i", "_region", F.col("_nested").isNotNull().alias("_nested"), F.posexplode_outer(F.when(F.col("_nested").isNotNull(), _objects(F.col("_nested"), ALERT_FIELDS)).otherwise(own)).alias("_j", "_alert")).where(F.col("_alert").isNotNull())
    first = lambda part, names: F.coalesce(*(F.col(part)[n] for n in names))
    either = lambda names, *more: F.coalesce(first("_alert", names), first("_region", (*names, *more)))
    key, name = F.coalesce(either(KEY_NAMES, "id"), F.lit("")), F.coalesce(either(NAME_NAMES, "name"), F.lit(""))
    flag = either(ACTIVE_NAMES)
    status = F.lower(F.coalesce(either(("status",)), F.lit("")))
    active = F.when(flag.isin("true", "false"), flag == "true").when(F.col("_nested"), F.lit(True)).otherwise(status.isin(*ACTIVE_WORDS))
    kind = F.coalesce(first("_alert", TYPE_NAMES), F.lit("AIR"))
    started = F.try_to_timestamp(either(START_NAMES))
    number = F.concat_ws("-", F.when(key != "", key).otherwise(name), F.upper(kind), F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss"), F.col("_i").cast("string"), F.col("_j").cast("string"))
    out = alerts.where((key != "") | (name != ""))
    return out.select(*bodies.columns, key.alias("location_key"), name.alias("location_name"), F.nullif(F.trim(either(("parentName", "parent_name"))), F.lit("")).alias("parent_name"), F.lower(kind).alias("alert_type"), active.alias("active"), started.alias("started_at"), F.coalesce(F.col("_alert")["id"], number).alias("external_id"))


def region_map(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """A feed that maps ids to regions with lists `districts` and `community`: the rows of the lists; the region itself is
    their rollup and left out."""
    entries = bodies.select(F.explode(F.from_json(body_col, "map<string, string>")).alias("region_key", "_v"))
    part = lambda name, level: entries.select("region_key", F.lit(level).alias("level"), F.explode(_array(F.get_json_object("_v", f"$.{name}"))).alias("_x"))
    return part("districts", "district").unionByName(part("community", "hromada")).select("region_key", "level", F.get_json_object("_x", "$.name").alias("name"), (F.get_json_object("_x", "$.alert") == "true").alias("active"))


def name_map(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """A feed that maps names to states."""
    return bodies.select(F.explode(F.from_json(body_col, "map<string, string>")).alias("name", "_v")).select("name", F.lower("_v").isin(*ACTIVE_WORDS).alias("active"))


#: Types of alerts from the air, and levels of a region array.
AIR_TYPES = ("AIR", "AIR_RAID")
ARRAY_LEVELS = ("State", "District", "Community")


def region_array(bodies: DataFrame, body_col: str = "body", stamp_col: str = "cached_at") -> DataFrame:
    """(checksum, name, level, changed_at) of the regions of a feed's array `raw` with an alert from the air.

    A region begins with the earliest stamp of its alerts, an alert's own or else the region's; one whose first alert has
    neither counts from the body's own stamp at the latest. A name that comes twice, in whatever case, is one region: the
    first one's name and level, the earliest beginning. Entries without a name or a list of alerts are left out, as are bodies
    without the array. The parsed shape is the whole of what is read, so more fields don't matter."""
    body = F.col(body_col)
    # each text is parsed once, in a step of its own, as a lambda computes what it mentions anew
    entries = _objects(_array(F.get_json_object(body, "$.raw")), ("regionName", "regionType", "lastUpdate", "activeAlerts"))

    def listed(e: Column) -> Column:
        name = F.btrim(F.regexp_replace(e["regionName"], r"\s+", " "))
        return F.struct(name.alias("name"), e["regionType"].alias("level"), e["lastUpdate"].alias("stamp"), _objects(_array(e["activeAlerts"]), ("type", "lastUpdate")).alias("alerts"))

    def begun(e: Column) -> Column:
        air = F.filter(e["alerts"], lambda a: F.upper(F.trim(a["type"])).isin(*AIR_TYPES))
        stamps = F.transform(air, lambda a: F.coalesce(F.try_to_timestamp(a["lastUpdate"]), F.try_to_timestamp(e["stamp"])))
        return F.struct(e["name"].alias("name"), e["level"].alias("level"), stamps.alias("at"))

    regions = F.transform(F.transform(entries, listed), begun)
    rows = bodies.select(F.sha2(body, 256).alias("checksum"), F.col(stamp_col).alias("_stamp"), F.posexplode_outer(regions).alias("_i", "_e")).where((F.col("_e.name") != "") & (F.size("_e.at") > 0))
    first = F.when(F.get("_e.at", F.lit(0)).isNull(), F.col("_stamp"))
    level = F.when(F.col("_e.level").isin(*ARRAY_LEVELS), F.col("_e.level")).otherwise("other")
    each = rows.select("checksum", "_i", F.col("_e.name").alias("_name"), level.alias("_level"), F.array_min(F.concat("_e.at", F.array(first))).alias("_began"))
    whole = each.groupBy("checksum", F.lower("_name").alias("_key")).agg(F.min_by("_name", "_i").alias("name"), F.min_by("_level", "_i").alias("level"), F.min("_began").alias("changed_at"))
    return whole.select("checksum", "name", "level", "changed_at")


def snapshot_body(regions: DataFrame, rollup: bool = False) -> DataFrame:
    """(checksum, body) of regions (checksum, name, level, changed_at): a body that alert_snapshot reads, regions by name. Of a
    feed that rolls up, a region of level State is an error: it would declare what nobody has declared."""
    refused = F.when(F.lit(rollup) & (F.col("level") == "State"), F.raise_error(F.concat(F.lit("a rollup may not assert a state: "), "name")).cast("string"))
    state = F.struct(F.coalesce(refused, F.col("name")).alias("regionName"), F.lit(True).alias("active"), F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startedAt"))
    return regions.groupBy("checksum").agg(F.to_json(F.struct(F.array_sort(F.collect_list(state)).alias("states"))).alias("body"))


#: Parsers by the name of their feed.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"snapshot": alert_snapshot, "region_array": region_array, "region_map": region_map, "name_map": name_map}


def fresh_bodies(bodies: DataFrame, at: datetime, stale_seconds: int, stamp_col: str = "cached_at") -> DataFrame:
    """Bodies whose cache stamp is neither older than the limit nor in the future."""
    age = (F.unix_micros(instant(at)) - F.unix_micros(stamp_col)) / 1e6
    return bodies.where((age >= 0) & (age <= stale_seconds))


def geojson_features(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """(checksum, n, kind, properties, rings): polygons and multipolygons of feature collections, rings as [[lon, lat], ...]."""
    schema = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    rows = bodies.select(F.sha2(body_col, 256).alias("checksum"), F.posexplode(F.from_json(body_col, schema)["features"]).alias("n", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = "array<array<array<double>>>"
    rings = F.when(kind == "Polygon", F.from_json(text, ring)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{ring}>")))
    return rows.select("checksum", "n", kind.alias("kind"), F.col("f.properties").alias("properties"), rings.alias("rings")).where(F.col("rings").isNotNull())


def carried_codes(rows: DataFrame, order: str, levels: list[str]) -> DataFrame:
    """A sheet that names each level once: the last code of every level carried down to the rows below it, per sheet."""
    window = Window.partitionBy("sheet").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in levels})
