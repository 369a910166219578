"""Fan-out and delivery: queue classes and coalescing, contiguous runs, recipients, decisions against what was sent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.folds import ordered_fold
from ..functions.numbers import EVIDENCE_LEVELS, ordinal
from ..functions.timeops import instant
from . import hierarchy

LEVELS = ("low", "guarded", "elevated", "high", "critical")


def delivery_class(kind: Column, payload: Column) -> Column:
    """protected, standard, soft, analytics or channel, by type and JSON payload; the first rule that holds decides."""
    path = lambda p: F.get_json_object(payload, p)
    update = kind == "threat_update"
    return (
        F.when(kind == "channel_publication", F.lit("channel"))
        .when(kind.isin("attack_debrief", "downtime_digest"), F.lit("analytics"))
        .when(update & path("$.timing").isNotNull() & (path("$.timing") != "now"), F.lit("soft"))
        .when(kind.isin("alert_start", "alert_end") | update & ((path("$.evidenceLevel") == "official") | (path("$.updateKind") == "escalation")), F.lit("protected"))
        .when(kind.isin("assessment_update", "nightly_digest"), F.lit("analytics"))
        .when(update & (path("$.updateKind") == "soft"), F.lit("soft"))
        .otherwise(F.lit("standard"))
    )


def coalesce_queue(outbox: DataFrame) -> DataFrame:
    """(id, keeper): queued assessments and soft updates that a newer one of the same chat, type and state key replaces.

    The newest of each key comes from an aggregate and is joined back, so that a chat with most rows is no window's group."""
    state = outbox.where(F.col("status").isin("pending", "retry"))
    state = state.withColumns({"state_kind": F.get_json_object("payload", "$.state.kind"), "state_key": F.get_json_object("payload", "$.state.key"), "update_kind": F.get_json_object("payload", "$.updateKind")})
    soft = (F.col("notification_type") == "assessment_update") | (F.col("notification_type") == "threat_update") & (F.col("update_kind") == "soft")
    state = state.where(soft & F.col("state_key").isNotNull()).select("id", "chat_id", "notification_type", F.coalesce("state_kind", F.lit("")).alias("state_kind"), "state_key", "created_at")
    key = ["chat_id", "notification_type", "state_kind", "state_key"]
    keeper = state.groupBy(*key).agg(F.max_by("id", F.struct("created_at", "id")).alias("keeper"))
    return state.join(keeper, key).where(F.col("id") != F.col("keeper")).select("id", "keeper")


def deliverable_run(log: DataFrame, cursor: int, at: datetime, grace: int = 60, most: int = 200) -> DataFrame:
    """The next rows of an ordered log after the cursor, up to the first gap that is younger than the grace.

    `most` is the feature's batch: only that many rows are looked at, so the window's one group is bounded."""
    batch = log.where(F.col("version") > cursor).orderBy("version").limit(most)
    order = Window.orderBy("version")
    expected = F.coalesce(F.lag("version").over(order), F.lit(cursor)) + 1
    young = F.unix_micros(instant(at)) - F.unix_micros("created_at") < grace * 1_000_000
    gap = ((F.col("version") != expected) & young).cast("int")
    return batch.withColumn("gaps", F.sum(gap).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("gaps = 0").drop("gaps")


def top_per_recipient(rows: DataFrame, recipient: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each recipient with their rank, and how many more there are."""
    total = rows.groupBy(recipient).agg(F.count("*").alias("_all"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(recipient).orderBy(*order))).where(F.col("rank") <= n)
    return ranked.join(total, recipient).withColumn("omitted", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def match_subscriptions(events: DataFrame, places: DataFrame, subscriptions: DataFrame, tree: DataFrame) -> DataFrame:
    """(event_id, chat_id, locations): subscriptions (chat_id, location_id, threat_type or null, least_evidence) that an
    event (event_id, threat_type, evidence_level) with a related place reaches."""
    near = hierarchy.related(tree, subscriptions.select(F.col("location_id").alias("id"))).select(F.col("root_id").alias("location_id"), F.col("location_id").alias("near_id"))
    wanted = subscriptions.join(near, "location_id").select("chat_id", F.col("threat_type").alias("wanted_type"), ordinal(F.col("least_evidence"), EVIDENCE_LEVELS).alias("least"), F.col("near_id").alias("location_id"))
    told = events.select("event_id", "threat_type", ordinal(F.col("evidence_level"), EVIDENCE_LEVELS).alias("level")).join(places, "event_id").join(wanted, "location_id")
    told = told.where((F.col("wanted_type").isNull() | (F.col("wanted_type") == F.col("threat_type"))) & (F.col("level") >= F.col("least")))
    return told.groupBy("event_id", "chat_id").agg(F.count_distinct("location_id").alias("locations"))


def kept_after_coalescing(rows: DataFrame, keys: list[str], at: str, window_seconds: float, tie: str) -> DataFrame:
    """rows with kept: false within the window after the last kept row of the key. A row that is not kept does not
    prolong the window; one exactly at its end is kept."""

    def step(last, row):
        now = getattr(row, at).value
        keep = last is None or now - last >= window_seconds * 1_000_000_000
        return (now if keep else last), (keep,)

    return ordered_fold(rows, keys, [at, tie], step, "kept boolean")


def assessment_decisions(rows: DataFrame, key: str, tie: str, cooldown_minutes: float = 30, least_change: float = 1.0) -> DataFrame:
    """rows (key, at, level, score) with action: against what was last sent, a higher level always goes out, a lower one
    and a drift only after the cooldown."""
    rank = {level: i for i, level in enumerate(LEVELS)}

    def step(sent, row):
        now = row.at.value
        if sent is None:
            return (row.level, row.score, now), ("initial",)
        level, score, when = sent
        change = rank[row.level] - rank[level]
        waiting = now - when < cooldown_minutes * 60_000_000_000
        if change > 0:
            action = "escalation"
        elif change < 0:
            action = "skip" if waiting else "deescalation"
        else:
            action = "skip" if waiting or abs(row.score - score) < least_change else "drift"
        return (sent if action == "skip" else (row.level, row.score, now)), (action,)

    return ordered_fold(rows, [key], ["at", tie], step, "action string")


def threat_decisions(rows: DataFrame, tie: str, extension_minutes: float = 15) -> DataFrame:
    """rows (chat_id, event_id, at, evidence_level, threat_type, location_ids, valid_until) with action, against the state
    last sent: initial, escalation, change, soft or skip."""
    rank = {level: i for i, level in enumerate(EVIDENCE_LEVELS)}

    def step(sent, row):
        places = set() if row.location_ids is None else set(row.location_ids)
        state = (row.evidence_level, row.threat_type, places, row.valid_until.value)
        if sent is None:
            return state, ("initial",)
        evidence, kind, known, until = sent
        if rank[row.evidence_level] > rank[evidence]:
            action = "escalation"
        elif row.threat_type != kind or known and places - known:
            action = "change"
        else:
            action = "soft" if row.valid_until.value - until > extension_minutes * 60_000_000_000 else "skip"
        return (sent if action == "skip" else state), (action,)

    return ordered_fold(rows, ["chat_id", "event_id"], ["at", tie], step, "action string")
