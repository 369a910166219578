"""Validity and state: as-of views, assertion lifecycles, alert reconciliation, idempotent and monotone writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeops import instant
from .trust import latest


def as_of(rows: DataFrame, cutoff: datetime) -> DataFrame:
    """What was public at the cutoff: later rows are gone, and rows that ended later are still active."""
    ended = F.col("ended_at") > instant(cutoff)
    status = F.when(ended, F.lit("active")).otherwise(F.col("status"))
    return rows.where(F.col("published_at") <= instant(cutoff)).withColumns({"status": status, "ended_at": F.when(~ended, F.col("ended_at"))})


def monotone_upsert(target: DataFrame, updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """target after updates of which the newest of a key wins, and wins only if it is not older than the row there."""
    order = [F.col(at), F.col("_new")]
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest(both, keys, order).drop("_new")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose natural key the target lacks, one for each key."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def revisions(messages: DataFrame) -> DataFrame:
    """Of (source_id, external_id, text, received_at): one row for each distinct text of a message, with its digest and
    number, in the order in which the texts were first seen."""
    key = ["source_id", "external_id"]
    seen = messages.withColumn("content_hash", F.sha2("text", 256)).groupBy(*key, "content_hash").agg(F.min("received_at").alias("first_seen"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("first_seen", "content_hash"))
    return seen.withColumn("revision", number)


def lifecycle(claims: DataFrame, withdrawals: DataFrame, keys: list[str], valid_seconds: int, tasks: int | None = None) -> DataFrame:
    """State of each claim after its assertions (keys, at) and withdrawals (keys, at) in the order of their instants: the
    last assertion opens it, the first withdrawal from then on closes it."""
    never = F.lit(None).cast("timestamp")
    opened = claims.select(*keys, F.col("at").alias("asserted_at"), never.alias("withdrawn_at"), F.lit(True).alias("claimed"))
    return lifecycle_of(opened.unionByName(withdrawals.select(*keys, never.alias("asserted_at"), F.col("at").alias("withdrawn_at"), F.lit(False).alias("claimed"))), keys, valid_seconds, tasks)


def lifecycle_of(facts: DataFrame, keys: list[str], valid_seconds: int, tasks: int | None = None) -> DataFrame:
    """lifecycle of facts (keys, asserted_at, withdrawn_at, claimed), each of which may assert, withdraw or do both; keys that none
    claims have no row. One shuffle by the keys, to so many tasks if given, and one sort of what a task gets."""
    known = F.lit(True)  # a withdrawal meets equal keys, and null equals none
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = facts.select(*keys, "asserted_at", "withdrawn_at", "claimed")
    rows = (rows.repartition(tasks, *keys) if tasks else rows).withColumn("_last", F.max("asserted_at").over(Window.partitionBy(*keys)))
    closing = F.when(known & (F.col("withdrawn_at") >= F.col("_last")), F.col("withdrawn_at"))
    state = rows.groupBy(*keys, F.col("_last").alias("asserted_at")).agg(F.min(closing).alias("withdrawn_at"), F.bool_or("claimed").alias("_claimed"))
    return state.where("_claimed").drop("_claimed").withColumn("valid_until", F.timestamp_micros(F.unix_micros("asserted_at") + valid_seconds * 1_000_000))


def support(claims: DataFrame, at: datetime) -> DataFrame:
    """(event_id, held, supported_until, claims): whether any claim still holds an event, and until when."""
    holds = F.col("withdrawn_at").isNull() & (F.col("valid_until") > instant(at))
    return claims.groupBy("event_id").agg(F.bool_or(holds).alias("held"), F.max(F.when(holds, F.col("valid_until"))).alias("supported_until"), F.count("*").alias("claims"))


def reconcile_alerts(states: DataFrame, sources: DataFrame, at: datetime, debounce: int, liveness: int) -> DataFrame:
    """The alert of each (location_id, alert_type) out of what each source says. Where an enabled interface is alive only
    interfaces vote; a dead source never outvotes a live one; a row that went missing holds for the debounce."""
    since = lambda column, seconds: F.coalesce(F.unix_micros(column) > F.unix_micros(instant(at)) - seconds * 1_000_000, F.lit(False))
    s = sources.select(F.col("id").alias("source_id"), "is_api", "enabled", since(F.col("last_success_at"), liveness).alias("alive"))
    # one row: whether there is such an interface
    available = s.agg(F.coalesce(F.bool_or(F.col("is_api") & F.col("enabled") & F.col("alive")), F.lit(False)).alias("api_available"))
    rows = states.join(s, "source_id").join(F.broadcast(available), F.lit(True))
    rows = rows.withColumns({"would_hold": F.col("active") | since(F.col("missing_since"), debounce), "counts": F.when(F.col("api_available"), F.col("is_api")).otherwise(F.lit(True))})
    key = ["location_id", "alert_type"]
    # who is alive is an aggregate of its own: a place's rows need not meet in one task for it
    alive = rows.groupBy(*key).agg(F.bool_or(F.col("counts") & F.col("alive")).alias("any_alive"))
    rows = rows.join(alive, key).withColumn("holds", F.col("would_hold") & (F.col("alive") | ~F.col("any_alive")))
    voted = F.col("counts") & F.col("holds")
    return rows.groupBy(*key).agg(
        F.bool_or(voted).alias("active"),
        F.min(F.when(voted, F.col("provider_started_at"))).alias("started_at"),
        F.count_if(~F.col("counts") & F.col("would_hold")).alias("ignored_precedence"),
        F.count_if(F.col("counts") & F.col("would_hold") & ~F.col("holds")).alias("ignored_stale"),
    )


def fold_snapshot(rows: DataFrame) -> DataFrame:
    """One row for each (location_id, alert_type) of a snapshot that names some twice: active if any is, from the earliest
    active start."""
    return rows.groupBy("location_id", "alert_type").agg(F.bool_or("active").alias("active"), F.min(F.when(F.col("active"), F.col("started_at"))).alias("started_at"))


def snapshot_changes(previous: DataFrame, present: DataFrame) -> DataFrame:
    """(location_id, alert_type, change): what a source's new snapshot lacks and what it adds."""
    key = ["location_id", "alert_type"]
    gone = previous.join(present, key, "left_anti").select(*key, F.lit("missing").alias("change"))
    return gone.unionByName(present.join(previous, key, "left_anti").select(*key, F.lit("appeared").alias("change")))


def freshness(sources: DataFrame, at: datetime, stale_after: int) -> DataFrame:
    """sources with status: disabled, never (no success yet), stale or fresh."""
    age = (F.unix_micros(instant(at)) - F.unix_micros("last_success_at")) / 1e6
    status = F.when(~F.col("enabled"), F.lit("disabled")).when(F.col("last_success_at").isNull(), F.lit("never")).when(age > stale_after, F.lit("stale")).otherwise(F.lit("fresh"))
    return sources.withColumn("status", status)


def expired(events: DataFrame, at: datetime) -> DataFrame:
    return events.where((F.col("status") == "active") & (F.col("valid_until") <= instant(at)))


def promotion(evidence: DataFrame, least_groups: int = 2) -> DataFrame:
    """(event_id, groups, level): confirmed by enough independent groups of tier A or B, model evidence left out."""
    counted = F.when(F.col("tier").isin("A", "B") & (F.col("origin") != "model"), F.col("independence_group"))
    groups = evidence.groupBy("event_id").agg(F.count_distinct(counted).alias("groups"), F.bool_or("official").alias("official"))
    level: Column = F.when(F.col("official"), F.lit("official")).when(F.col("groups") >= least_groups, F.lit("confirmed")).otherwise(F.lit("unverified"))
    return groups.select("event_id", "groups", level.alias("level"))
