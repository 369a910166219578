"""Risk scores: decaying signals, capped sums, guardrails, and which new assessments are worth publishing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import half_life, risk_level, rounded
from ..functions.timeops import instant, seconds_between
from .trust import trust_modifier

BASE = {"A": 2.5, "B": 1.5, "C": 0.6}
RELIABILITY = {"A": 1.0, "B": 0.75, "C": 0.4}
RELEVANCE = {"explicit": 1.0, "direction": 0.75, "mentioned": 0.55, "parent": 0.65, "national": 0.28}
SIGNAL_HOURS = 6
MOST_SCORE, ONLY_C, WITHOUT_A = 10.0, 3.9, 5.9
MATERIAL, JUMP = 0.5, 3.0


def _lookup(values: dict[str, float], key: Column) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(None).cast("double"))


def signals(reports: DataFrame) -> DataFrame:
    """A signal for each place and class of a report (id, tier, observed_at, places: array<struct<location_id, relation>>,
    classes): contribution by tier, reliability, geographic relevance by relation, expiry."""
    rows = reports.select("id", "tier", "observed_at", F.explode("places").alias("p"), "classes").select("id", "tier", "observed_at", "p.*", F.explode("classes").alias("threat_type"))
    relevance = _lookup(RELEVANCE, F.col("relation"))
    return rows.select("id", "location_id", "threat_type", "tier", "observed_at", _lookup(RELIABILITY, F.col("tier")).alias("reliability"), relevance.alias("geographic_relevance"), rounded(_lookup(BASE, F.col("tier")) * relevance, 3).alias("contribution"), F.timestamp_micros(F.unix_micros("observed_at") + SIGNAL_HOURS * 3_600_000_000).alias("expires_at"))


def effective(rows: DataFrame, as_of: datetime) -> DataFrame:
    """rows with effective_contribution: contribution, reliability, a half-life of two hours and the source's trust."""
    hours = seconds_between(F.col("observed_at"), instant(as_of)) / 3600
    return rows.withColumn("effective_contribution", F.col("contribution") * F.col("reliability") * half_life(hours, 2.0) * trust_modifier(F.col("source_trust")))


def live(rows: DataFrame, as_of: datetime) -> DataFrame:
    return rows.where((F.col("expires_at") > instant(as_of)) & F.col("location_id").isNotNull())


def assessments(rows: DataFrame) -> DataFrame:
    """Of effective() rows: score, confidence and strongest signal types of each place and class, before guardrails."""
    keys = ["location_id", "threat_type"]
    typed = rows.groupBy(*keys, "signal_type").agg(F.sum("effective_contribution").alias("weight"))
    tops = typed.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "signal_type"))), 1, 3), lambda x: x["signal_type"]).alias("top"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("signals"), F.sum("effective_contribution").alias("raw"), F.count_distinct("independence_group").alias("groups"), F.bool_or(F.col("source_tier") == "A").alias("has_a"), F.bool_and(F.col("source_tier") == "C").alias("only_c"))
    return sums.join(tops, keys).select(*keys, "signals", F.least(F.col("raw"), F.lit(MOST_SCORE)).alias("score"), "groups", "has_a", "only_c", F.when(F.col("groups") >= 2, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"), F.array_join("top", ",").alias("top_signals"))


def guarded(rows: DataFrame) -> DataFrame:
    """assessments() after the ceilings by tier and the rules on confidence, with the level."""
    ceiling = F.when(F.col("only_c"), F.lit(ONLY_C)).when(~F.col("has_a"), F.lit(WITHOUT_A)).otherwise(F.lit(MOST_SCORE))
    confidence = F.when(F.col("only_c") | (F.col("groups") < 2), F.lit("low")).when((F.col("confidence") == "high") & ~F.col("has_a"), F.lit("medium")).otherwise(F.col("confidence"))
    out = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.col("score"), ceiling))).withColumn("confidence", confidence)
    return out.withColumn("level", risk_level(F.col("score")))


def publication(candidates: DataFrame, previous: DataFrame, as_of: datetime, model: str) -> DataFrame:
    """What becomes of each guarded candidate: publish, extend the row that still says the same, or reject a jump that
    no source of tier A carries. previous has the latest published row of each place and class."""
    keys = ["location_id", "threat_type"]
    p = previous.select(*keys, F.col("score").alias("old_score"), F.col("level").alias("old_level"), F.col("model_version").alias("old_model"), "generated_at", "expires_at")
    rows = candidates.join(p, keys, "left")
    moved = F.abs(F.col("old_score") - F.col("score"))
    alive = (F.col("expires_at") > instant(as_of)) & (seconds_between(F.col("generated_at"), instant(as_of)) < SIGNAL_HOURS * 3600)
    same = alive & (F.col("old_level") == F.col("level")) & (F.col("old_model") == F.lit(model)) & (moved < MATERIAL)
    action = F.when((moved > JUMP) & ~F.col("has_a"), F.lit("reject")).when(F.coalesce(same, F.lit(False)), F.lit("extend")).otherwise(F.lit("publish"))
    return rows.select(*candidates.columns, action.alias("action"))
