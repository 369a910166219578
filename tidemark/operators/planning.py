"""Decisions over many rows at once: catching up, allowances, parents of places, context, additions, cones, checked reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.folds import ordered_fold
from ..functions.numbers import rounded
from ..functions.timeops import instant
from .movement import angle_between, bearing, destination, distance_km

MOST_BACKOFF = 24
#: The classes by severity, the least first.
SEVERITY = ("unknown", "mortar", "artillery", "mlrs", "uav", "guided_air_bomb", "aviation", "cruise_missile", "ballistic_missile", "combined")
MOST_ADDED_PLACES = 3
MOST_DIRECTION = 500
#: How far along its track a projection may be off, the most candidates, and which kind of place names a point.
ALONG_TRACK = 0.35
MOST_CANDIDATES = 6
SPECIFIC = ("city", "special_city", "hromada", "raion", "oblast")
#: How far a report's rate and median chance may be from ours.
TOLERANCE = {"relative": 0.15, "absolute": 0.05, "median": 0.15}


def catch_up(sources: DataFrame, now: datetime, least_gap: int = 3600, least_rerun: int = 600) -> DataFrame:
    """Of (source_id, enabled, cursor_at, last_run_at, failures): (source_id, gap_seconds, action). A source without a cursor
    has nothing to catch up with; after n failures in a row it rests for 2^n times the least rerun, 24 times at most."""
    at = F.unix_micros(instant(now))
    gap = F.coalesce(F.greatest(F.floor((at - F.unix_micros("cursor_at")) / 1e6), F.lit(0)), F.lit(0)).cast("long")
    rest = F.least(F.pow(F.lit(2.0), F.greatest(F.coalesce(F.col("failures"), F.lit(0)), F.lit(0))), F.lit(float(MOST_BACKOFF))) * least_rerun * 1e6
    action = (
        F.when(~F.coalesce(F.col("enabled"), F.lit(False)), "skipped_disabled")
        .when(F.col("cursor_at").isNull(), "no_cursor")
        .when(F.unix_micros("last_run_at") + rest > at, "skipped_recent")
        .when(gap <= least_gap, "skipped_small_gap")
        .otherwise("run")
    )
    return sources.select("source_id", gap.alias("gap_seconds"), action.alias("action"))


def missed_messages(messages: DataFrame, cursors: DataFrame, most_read: int, most_kept: int) -> DataFrame:
    """Of (source_id, id, at, text), newest first, at most most_read of each source are looked at; those after the source's
    cursor (source_id, cursor_at, cursor_id; ties by id) that have a text are kept, at most most_kept: (source_id, id, n), n
    being the order of their replay, the oldest first. Both bounds are the feature: the provider gives pages."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc("id"))
    read = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most_read)
    rows = read.join(cursors, "source_id")
    after = (F.col("at") > F.col("cursor_at")) | ((F.col("at") == F.col("cursor_at")) & (F.col("id") > F.col("cursor_id")))
    rows = rows.where(after & (F.btrim("text") != "")).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most_kept)
    return rows.select("source_id", "id", F.row_number().over(Window.partitionBy("source_id").orderBy("at", "id")).alias("n"))


def allowances(claims: DataFrame, rate: float, burst: int, most: int = 25) -> DataFrame:
    """Of (bucket, id, at, wanted): how many deliveries each claim may make of a bucket that fills at a rate up to its burst;
    it is full at first. Claims pass in the order of (at, id); (bucket, id, allowed)."""

    def step(state, row):
        tokens, last = state or (float(burst), row.at)
        tokens = min(float(burst), tokens + max(0.0, (row.at - last).total_seconds()) * rate)
        allowed = min(most, int(tokens), int(row.wanted))
        return (tokens - allowed, max(last, row.at)), (allowed,)

    return ordered_fold(claims.select("bucket", "id", "at", "wanted"), ["bucket"], ["at", "id"], step, "allowed int").select("bucket", "id", "allowed")


def array_rows(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """A row for each place of the arrays, as a batched insert writes them; the shorter ones are filled up with nulls."""
    return rows.select(*keys, F.inline(F.arrays_zip(*arrays))).toDF(*keys, *arrays)


def chosen_parents(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Of (code, parent_codes array, nearest first): (code, parent_code, moved), the parent being the first that is among the
    entries or the present rows (code, parent_code), null without one; moved if a present row had another one."""
    known = entries.select(F.col("code").alias("parent_code")).union(present.select("code")).distinct()
    wanted = entries.select("code", F.posexplode_outer("parent_codes").alias("_n", "parent_code"))
    nearest = wanted.join(known, "parent_code", "left_semi").groupBy("code").agg(F.min_by("parent_code", "_n").alias("parent_code"))
    before = present.select("code", F.col("parent_code").alias("_old"), F.lit(True).alias("_was"))
    rows = entries.select("code").distinct().join(nearest, "code", "left").join(before, "code", "left")
    moved = F.coalesce(F.col("_was"), F.lit(False)) & ~F.col("parent_code").eqNullSafe(F.col("_old"))
    return rows.select("code", "parent_code", moved.alias("moved"))


def context_places(mentions: DataFrame, regions: DataFrame, country: str) -> DataFrame:
    """Of (message_id, n, location_id) and (location_id, region_id): (message_id, places), the places that a message names
    in their order, then the regions above them by id, then the country; each once. A message names few places."""
    own = mentions.select("message_id", F.lit(0).alias("tier"), F.col("n").cast("long").alias("n"), F.col("location_id").alias("place"))
    above = mentions.join(regions, "location_id").where(F.col("region_id") != country).select("message_id", F.lit(1), F.lit(0).cast("long"), "region_id")
    rows = own.union(above).where(F.col("place") != country).groupBy("message_id", "place").agg(F.min(F.struct("tier", "n")).alias("at"))
    lists = rows.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda x: x["place"]).alias("places"))
    return mentions.select("message_id").distinct().join(lists, "message_id", "left").select("message_id", F.concat(F.coalesce("places", F.array().cast("array<string>")), F.array(F.lit(country))).alias("places"))


def severity(kind: Column) -> Column:
    place = F.array_position(F.array(*(F.lit(k) for k in SEVERITY)), kind)
    return F.when(place > 0, place - 1)


def additions(verdicts: DataFrame, published: DataFrame, names: DataFrame, least_confidence: float) -> DataFrame:
    """What a second reading may add to a published event, never take away: (event_id, kind, value, n).

    verdicts: event_id, significant, state, confidence, threat_type, direction, destinations, places (arrays of names);
    published: event_id, threat_type, direction, national, location_ids; names: name, location_id. A direction only where
    there is none, up to three places that aren't there yet (destinations first; none for a national event), and a class
    only if it is more severe. Verdicts that withdraw, doubt or name no class add nothing."""
    sure = (F.col("significant")) & F.col("state").isin("asserted", "redirected") & (F.col("confidence") >= least_confidence) & (severity(F.col("v.threat_type")) > 0)
    rows = verdicts.alias("v").join(published.alias("p"), "event_id").where(sure)
    said = F.btrim(F.regexp_replace(F.coalesce("v.direction", F.lit("")), r"\s+", " "))
    without = F.btrim(F.coalesce("p.direction", F.lit(""))) == ""
    directions = rows.where((said != "") & without).select("event_id", F.lit("direction").alias("kind"), F.substring(said, 1, MOST_DIRECTION).alias("value"), F.lit(1).alias("n"))
    classes = rows.where(severity(F.col("v.threat_type")) > severity(F.col("p.threat_type"))).select("event_id", F.lit("threat_class"), "v.threat_type", F.lit(1))
    listed = F.concat(F.coalesce("destinations", F.array().cast("array<string>")), F.coalesce("places", F.array().cast("array<string>")))
    named = rows.where(~F.coalesce("national", F.lit(False))).select("event_id", "location_ids", F.posexplode(listed).alias("_n", "name")).join(names, "name")
    new = named.where(~F.coalesce(F.array_contains("location_ids", F.col("location_id")), F.lit(False))).groupBy("event_id", "location_id").agg(F.min("_n").alias("_n"))
    first = new.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy("_n", "location_id"))).where(F.col("n") <= MOST_ADDED_PLACES)
    return directions.union(classes).union(first.select("event_id", F.lit("additional_location"), "location_id", "n"))


def cone_half_angle(segments: Column, approximate: Column, inferred: Column, elapsed: Column, sequence: Column, stale: Column) -> Column:
    """Degrees to either side of a projected course, from what is unsure about it: one segment only, rough coordinates,
    inferred times, under a minute between reports, a mere sequence of reports, seconds since the last one."""
    more = lambda condition, degrees: F.when(condition, degrees).otherwise(0.0)
    old = F.least(F.lit(20.0), F.floor(stale / 300) * 5)
    total = 12 + more(segments < 2, 8.0) + more(approximate, 10.0) + more(inferred, 8.0) + more((elapsed > 0) & (elapsed < 60), 6.0) + more(sequence, 6.0) + F.when(stale > 300, old).otherwise(0.0)
    return F.least(F.lit(60.0), rounded(total, 1))


def cone_ring(lat: Column, lon: Column, towards: Column, horizon_km: Column, half_angle: Column, radius_km: Column, steps: int = 12) -> Column:
    """The closed ring array<array<double>> ([lon, lat]) of the sector between the nearest and farthest reach."""
    near, far = F.greatest(F.lit(0.5), horizon_km * (1 - ALONG_TRACK)), horizon_km * (1 + ALONG_TRACK) + radius_km * 0.25

    def point(step: Column, km: Column) -> Column:
        to = destination(lat, lon, towards - half_angle + 2 * half_angle * step / steps, km)
        return F.array(to[1], to[0])

    along = F.sequence(F.lit(0), F.lit(steps))
    outer, inner = F.transform(along, lambda s: point(s, far)), F.transform(along, lambda s: point(steps - s, near))
    return F.concat(outer, inner, F.array(point(F.lit(0), far)))


def cone_candidates(origins: DataFrame, places: DataFrame) -> DataFrame:
    """Of (event_id, lat0, lon0, towards, horizon_km, half_angle, speed_kmh) and (id, type, lat, lon): the six places of each
    sector that are least off its course, the most specific of those at one point: (event_id, rank, id, off, km, minutes,
    within). Events of the same sectors are searched once, and so are places at the same point, of which the most specific
    alone can count; sectors meet points by cells of a degree both ways."""
    sector = F.struct("lat0", "lon0", "towards", "horizon_km", "half_angle", "speed_kmh")
    cones = origins.groupBy("event_id").agg(F.array_sort(F.collect_set(sector)).alias("cone"))
    kind = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in SPECIFIC)), F.col("type")), F.lit(0)), F.lit(10))
    points = places.groupBy("lat", "lon").agg(F.min(F.struct(kind.alias("kind"), "id")).alias("_p")).select("lat", "lon", "_p.*")
    reach = F.col("horizon_km") * (1 + ALONG_TRACK) * 1.15
    # a degree of latitude is 111.19 km on this sphere; one of longitude is shorter by the cosine of the latitude, and near a
    # pole a sector may reach around it
    degrees = reach / 111.0
    aside = F.asin(F.sin(F.radians(degrees)) / F.cos(F.radians("lat0")))
    wide = F.when((F.abs("lat0") + degrees < 89) & (degrees < 89), F.degrees(aside) + 0.01).otherwise(F.lit(180.0))
    cells = lambda at, by: F.sequence(F.floor(at - by).cast("int"), F.floor(at + by).cast("int"))
    turned = F.array_distinct(F.transform(cells(F.col("lon0"), wide), lambda x: F.pmod(x, F.lit(360))))
    # a cone goes by one of its events; few and small rows make many pairs, so they are dealt to a fixed number of tasks
    owners = cones.groupBy("cone").agg(F.min("event_id").alias("owner"))
    n = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = owners.repartition(n, "owner").select("owner", F.explode("cone").alias("_s")).select("owner", "_s.*")
    dealt = each.where(degrees >= 0).withColumn("_y", F.explode(cells(F.col("lat0"), degrees))).withColumn("_x", F.explode(turned))
    met = dealt.join(points.withColumns({"_y": F.floor("lat").cast("int"), "_x": F.pmod(F.floor("lon").cast("int"), F.lit(360))}), ["_y", "_x"])
    here = F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")
    met = met.where((F.abs(F.col("lat") - F.col("lat0")) <= degrees) & (F.abs(angle_between(F.col("lon"), F.col("lon0"))) <= wide))
    met = met.withColumn("km", distance_km(*here)).where((F.col("km") >= F.greatest(F.lit(1.0), F.col("horizon_km") * (1 - ALONG_TRACK) * 0.6)) & (F.col("km") <= reach))
    met = met.withColumn("off", F.abs(angle_between(bearing(*here), F.col("towards")))).where(F.col("off") <= F.col("half_angle") * 1.5)
    point = [rounded(F.col("lon"), 4), rounded(F.col("lat"), 4)]
    one = met.withColumn("_r", F.row_number().over(Window.partitionBy("owner", *point).orderBy("kind", "off", "km", "id"))).where("_r = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy("off", "km", "id"))).where(F.col("rank") <= MOST_CANDIDATES)
    out = cones.join(owners.join(ranked.withColumnRenamed("owner", "_owner"), F.col("owner").eqNullSafe(F.col("_owner"))), "cone")
    return out.select("event_id", "rank", "id", rounded(F.col("off"), 1).alias("off"), rounded(F.col("km"), 1).alias("km"), rounded(F.col("km") / F.col("speed_kmh") * 60, 1).alias("minutes"), (F.col("off") <= F.col("half_angle")).alias("within"))


def checked_report(intervals: Column, rate: Column, chances: Column) -> Column:
    """struct<verdict, issues, rate, median> of a report: its own rate and its chances by day against the rate of its
    intervals in days (rejected without a chance; inconsistent if it has no usable intervals or is beyond the tolerance)."""
    usable = F.filter(intervals, lambda x: x >= 0)
    mean = F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / F.size(usable)
    ours = F.when((F.size(usable) > 0) & (mean > 0), rounded(1 / mean))
    ordered, n = F.array_sort(F.filter(chances, lambda x: x.isNotNull())), F.size(F.filter(chances, lambda x: x.isNotNull()))
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    far_rate = F.abs(rate - ours) > F.greatest(F.lit(TOLERANCE["absolute"]), ours * TOLERANCE["relative"])
    far_median = F.abs(middle - rounded(1 - F.exp(-1 / mean))) > TOLERANCE["median"]
    issues = F.array_compact(F.array(
        F.when(ours.isNull(), F.lit("intervals_missing")),
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("forecast_outside_period")),
        F.when(far_rate, F.lit("lambda_mismatch")),
        F.when(ours.isNotNull() & far_median, F.lit("p_mismatch")),
    ))
    verdict = F.when(F.array_contains(issues, "forecast_outside_period"), "rejected").when(F.size(issues) > 0, "inconsistent").otherwise("passed")
    return F.struct(verdict.alias("verdict"), issues.alias("issues"), ours.alias("rate"), rounded(middle).alias("median"))
