"""What is told about one place, one event or one night: evidence by hour band, upstream places, details, latest states."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import count_where, share
from ..functions.timeops import instant, local_hour
from .archive import mentioned_classes
from .trust import latest

TYPICAL_MESSAGES, TYPICAL_SHARE = 3, 0.15


def band_evidence(messages: DataFrame, hours: list[int]) -> DataFrame:
    """(dimension, key, in_band, messages): by class, local hour and version, and in total, in one pass."""
    hour = local_hour(F.col("published_at"))
    one = lambda dimension, key: F.array(F.struct(F.lit(dimension).alias("dimension"), key.cast("string").alias("key")))
    classes = F.transform(mentioned_classes(), lambda c: F.struct(F.lit("class").alias("dimension"), c.alias("key")))
    rows = messages.select(hour.isin(hours).alias("band"), F.explode(F.concat(one("total", F.lit("all")), classes, one("hour", F.lpad(hour.cast("string"), 2, "0")), one("version", F.col("classifier_version")))).alias("d"))
    return rows.groupBy("d.dimension", "d.key").agg(count_where(F.col("band")).alias("in_band"), F.count("*").alias("messages"))


def band_class(observed_now: Column, in_band: Column, band_total: Column) -> Column:
    """observed_now, typical, atypical or never."""
    typical = (in_band >= TYPICAL_MESSAGES) & (share(in_band, band_total) >= TYPICAL_SHARE)
    return F.when(observed_now, F.lit("observed_now")).when(typical, F.lit("typical")).when(in_band >= 1, F.lit("atypical")).otherwise(F.lit("never"))


def upstream(messages: DataFrame, bridge: DataFrame, near: DataFrame) -> DataFrame:
    """(location_id, occurrences): from where messages redirect to one of the places of `near`, coming from outside them."""
    side = lambda role: bridge.where(F.col("role") == role).select(F.col("classification_id").alias("id"), "location_id")
    arriving = side("asserted").join(near.select("location_id"), "location_id", "left_semi")
    leaving = side("retracted").join(near.select("location_id"), "location_id", "left_anti")
    moves = messages.where(F.col("decision") == "redirect").select("id").join(leaving, "id").join(arriving.select("id", F.lit(1).alias("one")), "id")
    return moves.groupBy("location_id").agg(F.count("*").alias("occurrences"))


def rolling_counts(messages: DataFrame, now: datetime, hours: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """One row: messages and events raised within each of the last hours."""
    recent = messages.where((F.col("published_at") > instant(now - timedelta(hours=max(hours)))) & (F.col("published_at") <= instant(now)))
    within = lambda h: F.col("published_at") > instant(now - timedelta(hours=h))
    return recent.agg(*(x for h in hours for x in (count_where(within(h)).alias(f"messages_{h}h"), count_where(within(h) & F.col("created_event")).alias(f"events_{h}h"))))


def zone_activity(messages: DataFrame, now: datetime, minutes: int = 90) -> DataFrame:
    """(origin_zone, threat_types, last_reported_at, reports, sources) of what was reported within the last minutes."""
    recent = messages.where(F.col("origin_zone").isNotNull() & (F.col("published_at") > instant(now - timedelta(minutes=minutes))))
    return recent.groupBy("origin_zone").agg(F.array_sort(F.collect_set("threat_type")).alias("threat_types"), F.max("published_at").alias("last_reported_at"), F.count("*").alias("reports"), F.count_distinct("source_id").alias("sources"))


def model_signal_counts(signals: DataFrame, events: DataFrame) -> DataFrame:
    """(signal_type, signals) of the signals of events that the model has made."""
    return signals.join(events.where(F.col("origin") == "model").select("event_id"), "event_id", "left_semi").groupBy("signal_type").agg(F.count("*").alias("signals"))


def verdict_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(was, became, messages) of the decisions that a replay changes; messages that only one side knows have null there."""
    both = old.select("message_id", F.col("decision").alias("was")).join(new.select("message_id", F.col("decision").alias("became")), "message_id", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("became"))).groupBy("was", "became").agg(F.count("*").alias("messages"))


def latest_states(reports: DataFrame) -> DataFrame:
    """(region_id, latest, pending, terminal): of each region the ids of its newest report, of its newest one that waits, and
    of its newest one that is done or failed. reports: (region_id, id, created_at, status)."""
    order = [F.col("created_at"), F.col("id")]
    newest = lambda rows, name: latest(rows, ["region_id"], order).select("region_id", F.col("id").alias(name))
    out = newest(reports, "latest")
    out = out.join(newest(reports.where(F.col("status").isin("pending", "running")), "pending"), "region_id", "left")
    return out.join(newest(reports.where(F.col("status").isin("done", "failed")), "terminal"), "region_id", "left")


def event_details(events: DataFrame, places: DataFrame, evidence: DataFrame) -> DataFrame:
    """event_id with places and evidence as JSON arrays in a fixed order. Each branch is aggregated before the joins, so
    that places and evidence don't multiply."""
    p = places.groupBy("event_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("location_id", "role")))).alias("places"))
    e = evidence.groupBy("event_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "source_id"))), lambda x: F.struct(x["id"].alias("id"), x["source_id"].alias("source_id")))).alias("evidence"), F.count("*").alias("n_evidence"))
    none = F.lit("[]")
    return events.join(p, "event_id", "left").join(e, "event_id", "left").select("event_id", F.coalesce("places", none).alias("places"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def movement_facts(evidence: DataFrame, n: int = 12) -> DataFrame:
    """Of each event the newest n reports (event_id, id, source_id, at), those of one source at one instant once."""
    one = evidence.groupBy("event_id", "source_id", "at").agg(F.min("id").alias("id"))
    order = Window.partitionBy("event_id").orderBy(F.desc("at"), "id")
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def recommended_channels(channels: DataFrame, near: DataFrame, chunks: int = 64) -> DataFrame:
    """(location_id, channel_id): channels of the whole country and those of a related place, for each place that `near`
    (root_id, location_id) relates. Those of the country are beside every place: they are dealt to chunks, which meet the
    places by their numbers, so that no row holds all of them and none must be broadcast."""
    local = channels.where(F.col("location_id").isNotNull()).join(near, "location_id").select(F.col("root_id").alias("location_id"), "channel_id")
    everywhere = channels.where(F.col("location_id").isNull()).groupBy(F.pmod(F.xxhash64("channel_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_set("channel_id").alias("some"))
    places = near.select(F.col("root_id").alias("location_id")).distinct().select("location_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    national = places.join(everywhere, "chunk").select("location_id", F.explode("some").alias("channel_id"))
    return local.unionByName(national).distinct()


def debrief(messages: DataFrame, started: datetime, ended: datetime) -> DataFrame:
    """(threat_type, messages, peak, sources, first_at, last_at) of a night: peak is the largest number that one message
    names; numbers are never added up. messages: (threat_type, count, source_id, published_at)."""
    rows = messages.where((F.col("published_at") >= instant(started)) & (F.col("published_at") <= instant(ended)))
    return rows.groupBy("threat_type").agg(F.count("*").alias("messages"), F.max("count").alias("peak"), F.count_distinct("source_id").alias("sources"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
