"""Timelines, waves of messages, and what is told of a period from them.

A period is reduced to its buckets first (at most a few thousand rows for each key, whatever the archive's size); only those
small spines are ordered. keys, such as the source, give each of their values a timeline and waves of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import count_where, delta_percent, rounded, share, trend
from ..functions.timeops import epoch_bucket, local_hour, seconds_between
from .archive import mentioned_classes

GAP_SECONDS, LEAST_MESSAGES = 90 * 60, 2
LEAST_WAVES, MOST_PAIRS = 2, 6
NIGHT = (22, 23, 0, 1, 2, 3, 4, 5)


def timeline(messages: DataFrame, minutes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, at, threat_type, messages, events_raised, first_at, last_at): a row for each bucket with class null, and one for
    each class in it. A message counts once for each of its classes."""
    counts = (F.count("*").alias("messages"), count_where(F.col("created_event")).alias("events_raised"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    rows = messages.select(*keys, epoch_bucket(F.col("published_at"), minutes).alias("at"), "published_at", "created_event", mentioned_classes().alias("classes"))
    spine = rows.groupBy(*keys, "at").agg(*counts).withColumn("threat_type", F.lit(None).cast("string"))
    typed = rows.select(*keys, "at", "published_at", "created_event", F.explode("classes").alias("threat_type")).groupBy(*keys, "at", "threat_type").agg(*counts)
    return spine.unionByName(typed)


def numbered_waves(spine: DataFrame, gap: int = GAP_SECONDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """The spine with the number of the wave of each bucket: a new one begins after a silence longer than the gap."""
    order = Window.partitionBy(*keys).orderBy("at")  # over buckets of one period
    apart = seconds_between(F.lag("last_at").over(order), F.col("first_at")) > gap
    begins = spine.withColumn("begins", F.when(apart.isNull() | apart, 1).otherwise(0))
    return begins.withColumn("wave", F.sum("begins").over(order)).drop("begins")


def waves(points: DataFrame, gap: int = GAP_SECONDS, least: int = LEAST_MESSAGES, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, wave, started_at, ended_at, messages, events_raised, seconds) of the waves with at least `least` messages."""
    numbered = numbered_waves(points.where(F.col("threat_type").isNull()), gap, keys)
    rows = numbered.groupBy(*keys, "wave").agg(F.min("first_at").alias("started_at"), F.max("last_at").alias("ended_at"), F.sum("messages").alias("messages"), F.sum("events_raised").alias("events_raised"))
    return rows.where(F.col("messages") >= least).withColumn("seconds", rounded(seconds_between(F.col("started_at"), F.col("ended_at")), 1))


def wave_classes(points: DataFrame, gap: int = GAP_SECONDS, least: int = LEAST_MESSAGES, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, wave, threat_type, messages): the composition of each wave."""
    numbered = numbered_waves(points.where(F.col("threat_type").isNull()), gap, keys)
    kept = Window.partitionBy(*keys, "wave")
    own = numbered.withColumn("total", F.sum("messages").over(kept)).where(F.col("total") >= least).select(*keys, "at", "wave")
    return points.where(F.col("threat_type").isNotNull()).join(own, [*keys, "at"]).groupBy(*keys, "wave", "threat_type").agg(F.sum("messages").alias("messages"))


def repeated_pairs(composition: DataFrame, least: int = LEAST_WAVES, most: int = MOST_PAIRS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of classes that occur together in at least `least` waves, most frequent first."""
    named = composition.where(~F.col("threat_type").isin("unknown", "combined"))
    sets = named.groupBy(*keys, "wave").agg(F.array_sort(F.collect_set("threat_type")).alias("s"))  # at most ten classes exist
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("waves"))
    return counts.where(F.col("waves") >= least).orderBy(F.desc("waves"), "a", "b").limit(most)


def hour_histogram(messages: DataFrame) -> DataFrame:
    """(hour, messages) of all 24 local hours."""
    found = messages.groupBy(local_hour(F.col("published_at")).alias("hour")).agg(F.count("*").alias("messages"))
    hours = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("messages", F.lit(0)).alias("messages"))


def night_share(hours: DataFrame) -> DataFrame:
    """One row: the share of 22-06, and the hour with the most messages (the earliest of equals)."""
    return hours.agg(rounded(share(F.sum(F.when(F.col("hour").isin(*NIGHT), F.col("messages")).otherwise(0)), F.sum("messages"))).alias("night_share"), F.min_by("hour", F.struct(-F.col("messages"), F.col("hour"))).alias("peak_hour"))


def modal_band(hours: DataFrame, size: int = 3) -> DataFrame:
    """One row: the start of the `size` hours in a row, around the clock, with the most messages, and their share."""
    spread = hours.select(F.explode(F.array(*((F.col("hour") - i + 24) % 24 for i in range(size)))).alias("start"), "messages")
    bands = spread.groupBy("start").agg(F.sum("messages").alias("messages"))
    best = bands.agg(F.min_by("start", F.struct(-F.col("messages"), F.col("start"))).alias("band_start"), F.max("messages").alias("band_messages"), F.sum("messages").alias("all"))
    return best.select("band_start", "band_messages", rounded(share(F.col("band_messages") * size, F.col("all"))).alias("band_share"))


def period_dimensions(messages: DataFrame, current: Column, regions: DataFrame, bridge: DataFrame) -> DataFrame:
    """(dimension, key, messages, events, previous_messages, previous_events) of two adjacent periods: in total, by
    class, region, hour, version and direction. current is true in the later one."""
    counts = (count_where(F.col("now")).alias("messages"), count_where(F.col("now") & F.col("created_event")).alias("events"), count_where(~F.col("now")).alias("previous_messages"), count_where(~F.col("now") & F.col("created_event")).alias("previous_events"))
    placed = bridge.where(F.col("role") == "asserted").join(regions, "location_id").select(F.col("classification_id").alias("id"), "region_id").distinct()
    base = messages.withColumn("now", current)
    one = lambda dimension, key: F.array(F.struct(F.lit(dimension).alias("dimension"), key.cast("string").alias("key")))
    direction = F.when(F.col("direction_text").isNotNull(), one("direction", F.lower(F.substring(F.trim("direction_text"), 1, 80))))
    classes = F.transform(mentioned_classes(), lambda c: F.struct(F.lit("class").alias("dimension"), c.alias("key")))
    none = F.array().cast("array<struct<dimension:string,key:string>>")
    own = F.concat(one("total", F.lit("all")), classes, one("hour", F.lpad(local_hour(F.col("published_at")).cast("string"), 2, "0")), one("version", F.col("classifier_version")), F.coalesce(direction, none))
    # messages meet their regions once; everything else that a message counts for lies in its row
    rows = base.select("now", "created_event", F.explode(own).alias("d")).select("now", "created_event", "d.*")
    places = base.select("id", "now", "created_event").join(placed, "id").select("now", "created_event", F.lit("region").alias("dimension"), F.col("region_id").alias("key"))
    return rows.unionByName(places).groupBy("dimension", "key").agg(*counts)


def composed(dimensions: DataFrame, dimension: str) -> DataFrame:
    """A dimension's rows with shares of its sum, trend and change in percent."""
    rows = dimensions.where(F.col("dimension") == dimension)
    whole = Window.partitionBy("dimension")
    return rows.select("key", "messages", "previous_messages", rounded(share(F.col("messages"), F.sum("messages").over(whole))).alias("share"), trend(F.col("messages"), F.col("previous_messages")).alias("trend"), delta_percent(F.col("messages"), F.col("previous_messages")).alias("delta_percent"))


def monthly_rollup(periods: DataFrame) -> DataFrame:
    """(month, location_id, periods, total_seconds, mean_seconds, longest_seconds) of ended intervals, by local month."""
    month = F.date_format(F.date_trunc("month", F.from_utc_timestamp("started_at", "Europe/Kyiv")), "yyyy-MM-dd")
    length = seconds_between(F.col("started_at"), F.col("ended_at"))
    return periods.where(F.col("ended_at").isNotNull()).groupBy(month.alias("month"), "location_id").agg(F.count("*").alias("periods"), rounded(F.sum(length), 1).alias("total_seconds"), rounded(F.avg(length), 1).alias("mean_seconds"), rounded(F.max(length), 1).alias("longest_seconds"))
