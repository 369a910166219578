"""Writes as set operations: logs with versions, outboxes, archives with children, guards, decay, retention, replay."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.folds import ordered_fold
from ..functions.timeops import instant


def versioned_log(rows: DataFrame, at: str, key: str, last_version: int = 0) -> DataFrame:
    """rows with version: numbers after last_version in the order of (at, key), without gaps. Rows are numbered within
    their hours, and the hours, which are few, by the sums of those before."""
    hour = F.date_trunc("hour", F.col(at))
    numbered = rows.withColumns({"_hour": hour, "_n": F.row_number().over(Window.partitionBy(hour).orderBy(at, key))})
    counts = rows.groupBy(hour.alias("_hour")).agg(F.count("*").alias("_c"))
    before = counts.select("_hour", (F.sum("_c").over(Window.orderBy(F.asc_nulls_first("_hour"))) - F.col("_c")).alias("_before"))
    joined = numbered.alias("r").join(before.alias("b"), F.col("r._hour").eqNullSafe(F.col("b._hour")))
    return joined.select("r.*", (F.col("_before") + F.col("_n") + last_version).cast("long").alias("version")).drop("_hour", "_n")


def outbox(events: DataFrame, recipients: DataFrame, on: list[str], sent: DataFrame) -> DataFrame:
    """(idempotency_key, recipient_id, event_id) to be sent: one row for each recipient and event that they share a value of
    `on` with, less those whose key is in `sent`."""
    key = F.concat_ws(":", F.col("recipient_id").cast("string"), F.col("event_id").cast("string"))
    rows = events.join(recipients, on).select(key.alias("idempotency_key"), "recipient_id", "event_id").dropDuplicates(["idempotency_key"])
    return rows.join(sent.select("idempotency_key"), "idempotency_key", "left_anti")


def archive_verdicts(verdicts: DataFrame, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, children) to be added: verdicts whose (message_id, version) the archive lacks, one for each, and their
    places in both roles. Children are added for new parents only."""
    key = ["message_id", "version"]
    parents = verdicts.dropDuplicates(key).join(archived.select(*key), key, "left_anti")
    side = lambda role, column: parents.select(*key, F.explode(F.array_distinct(column)).alias("location_id")).withColumn("role", F.lit(role))
    return parents, side("asserted", "asserted_places").unionByName(side("retracted", "retracted_places"))


def guarded_insert(rows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason): enrichments of events that exist, aren't official, are written by rules, and still
    have the class that the enrichment saw."""
    e = events.select("event_id", F.lit(True).alias("there"), F.col("evidence").alias("now_evidence"), F.col("origin").alias("now_origin"), F.col("threat_type").alias("now_type"))
    reason = F.when(F.col("there").isNull(), F.lit("missing")).when(F.col("now_evidence") == "official", F.lit("official")).when(F.col("now_origin") != "rules", F.lit("not_rules")).when(~F.col("now_type").eqNullSafe(F.col("seen_type")), F.lit("changed"))
    judged = rows.join(e, "event_id", "left").withColumn("reason", reason).select(*rows.columns, "reason")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def after_deletions(queue: DataFrame, deleted: DataFrame) -> DataFrame:
    """The queue less the rows of deleted users; rows of channels stay."""
    gone = deleted.select(F.col("user_id").alias("recipient_id"), F.lit("user").alias("kind"))
    return queue.join(gone, ["recipient_id", "kind"], "left_anti")


def retained(rows: DataFrame, at: str, now: datetime, days: int) -> DataFrame:
    """Rows not older than so many days; rows without an instant stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= instant(now - timedelta(days=days))))


def decayed(signals: DataFrame, withdrawn: DataFrame, factor: float) -> DataFrame:
    """signals with the contribution of those whose (source_id, event_id) is withdrawn times the factor, and decayed."""
    key = ["source_id", "event_id"]
    hit = signals.join(withdrawn.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    decay = F.col("_hit").isNotNull()
    return hit.withColumns({"contribution": F.when(decay, F.col("contribution") * factor).otherwise(F.col("contribution")), "decayed": decay}).select(*signals.columns, "decayed")


def published_by(rows: DataFrame, at: str, now: datetime, delay: timedelta, mode_changed: datetime) -> DataFrame:
    """What may be seen now: rows up to the later of the delayed instant and the last change of mode, never back."""
    return rows.where(F.col(at) <= instant(max(now - delay, min(mode_changed, now))))


def replayed(buffered: DataFrame, live: DataFrame, after: int) -> DataFrame:
    """Each version after the last one that was seen, once, whichever of the two brought it."""
    return buffered.unionByName(live).where(F.col("version") > after).dropDuplicates(["version"])


def stuck(states: DataFrame, now: datetime, most: timedelta) -> DataFrame:
    """states in which what has gone on for longer than `most` is ended at that bound, with reason stuck."""
    bound = F.timestamp_micros(F.unix_micros("started_at") + int(most.total_seconds() * 1e6))
    over = F.col("ended_at").isNull() & (bound < instant(now))
    return states.withColumns({"ended_at": F.when(over, bound).otherwise(F.col("ended_at")), "reason": F.when(over, F.lit("stuck"))})


def withdrawal_outcome(requests: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, outcome) of requests to take back an event of the model: not_found, not_model, not_live or withdrawn."""
    e = events.select("event_id", F.lit(True).alias("there"), "origin", "status")
    outcome = F.when(F.col("there").isNull(), F.lit("not_found")).when(F.col("origin") != "model", F.lit("not_model")).when(~F.col("status").isin("observed", "confirmed", "active"), F.lit("not_live")).otherwise(F.lit("withdrawn"))
    return requests.select("event_id").distinct().join(e, "event_id", "left").select("event_id", outcome.alias("outcome"))


def claimable(queue: DataFrame, now: datetime, n: int) -> DataFrame:
    """The n rows that a worker would take next: due, pending, most urgent first, then the oldest; never-tried ones first."""
    due = queue.where((F.col("status") == "pending") & (F.coalesce("not_before", instant(now)) <= instant(now)))
    return due.orderBy(F.asc("priority"), F.asc_nulls_first("last_tried_at"), F.asc("created_at"), F.asc("id")).limit(n)


def backoff_seconds(failures: Column, base: int, most: int) -> Column:
    """base times two to the number of failures, at most `most`."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(failures, F.lit(30))), F.lit(most)).cast("long")


def _with_stretches(rows: DataFrame, gap: int, slot: int) -> DataFrame:
    """rows (threat_type, us_at, id) with stretch: a number for each run of a class without a silence of gap microseconds.

    Within slots of time, which no class fills alone; what goes from slot to slot is one row for each."""
    key, same = ["threat_type", "slot"], F.col("r.threat_type").eqNullSafe(F.col("s.threat_type")) & (F.col("r.slot") == F.col("s.slot"))
    rows = rows.withColumn("slot", F.floor(F.col("us_at") / slot))
    by_slot = Window.partitionBy("threat_type").orderBy("slot")
    slots = rows.groupBy(*key).agg(F.max("us_at").alias("last_at")).select(*key, F.lag("last_at").over(by_slot).alias("before_at"))
    in_slot = Window.partitionBy(*key).orderBy("us_at", "id")
    met = rows.alias("r").join(slots.alias("s"), same).select("r.*", "before_at")
    since = F.col("us_at") - F.coalesce(F.lag("us_at").over(in_slot), F.col("before_at"))
    begun = met.withColumn("begins", F.when(F.coalesce(since >= gap, F.lit(True)), 1).otherwise(0)).drop("before_at")
    earlier = begun.groupBy(*key).agg(F.sum("begins").alias("own")).select(*key, F.coalesce(F.sum("own").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = begun.withColumn("within", F.sum("begins").over(in_slot)).alias("r").join(earlier.alias("s"), same).select("r.*", "earlier")
    return numbered.withColumn("stretch", F.col("earlier") + F.col("within")).drop("slot", "begins", "within", "earlier")


def merged_events(messages: DataFrame, live_seconds: int = 1800, slot_seconds: int = 21_600) -> DataFrame:
    """messages with event_key and created: a message joins the live event of its class that was seen last among those
    which share a place with it and were seen within live_seconds, else it makes one, whose key is its id. messages: (id,
    threat_type, published_at, places array). After a silence of live_seconds in a class nothing is live, so each stretch
    between silences is folded on its own, wherever a class may have a third of all messages; what a fold keeps are the live
    events of one stretch. A class that is never silent is one stretch, as each of its messages may depend on all before.
    Messages without places make events that nothing joins."""
    rows = _with_stretches(messages.withColumn("us_at", F.unix_micros("published_at")), live_seconds * 1_000_000, slot_seconds * 1_000_000)

    def step(live: Any, row: Any) -> tuple[Any, tuple]:
        places = set(row.places) if row.places is not None else set()
        live = [e for e in live or [] if row.us_at - e[0] < live_seconds * 1_000_000]
        joined = [e for e in live if e[2] & places]
        if not joined:
            return [*live, (row.us_at, row.id, places)], (row.id, True)
        best = max(joined, key=lambda e: (e[0], e[1]))
        live.remove(best)
        return [*live, (row.us_at, best[1], best[2] | places)], (best[1], False)

    folded = ordered_fold(rows, ["threat_type", "stretch"], ["published_at", "id"], step, "event_key string, created boolean")
    return folded.drop("us_at", "stretch")
