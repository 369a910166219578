"""How far a source has earned trust: decayed shares of what it claimed, led, and failed to make readable."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clamp, half_life, rounded
from ..functions.timeops import age_days, instant, seconds_between

WINDOW_DAYS, HALF_LIFE_DAYS, LEAST_SAMPLE, NEUTRAL, LAG_REFERENCE_SECONDS = 30, 10.0, 20, 0.5, 1800.0
WEIGHTS = {"withdrawn": 0.35, "corroborated": 0.25, "lead": 0.15, "lag": 0.10, "unreadable": 0.15}
FLOOR, CEILING = 0.6, 1.2
HIGH_FROM, REDUCED_TO = 0.65, 0.40


def _weighted(flag: Column) -> Column:
    return F.when(F.sum("weight") > 0, F.sum(F.when(flag, F.col("weight"))) / F.sum("weight"))


def assertion_metrics(assertions: DataFrame, as_of: datetime, days: int = WINDOW_DAYS, half: float = HALF_LIFE_DAYS) -> DataFrame:
    """(source_id, sample_size, withdrawn_share, corroborated_share): an event is corroborated if another group asserted it."""
    recent = assertions.where(F.col("asserted_at") >= instant(as_of - timedelta(days=days)))
    per_event = recent.groupBy("source_id", "event_id", "independence_group").agg(F.min("asserted_at").alias("at"), F.bool_or(F.col("withdrawn_at").isNotNull()).alias("withdrawn"))
    groups = recent.groupBy("event_id").agg(F.count_distinct("independence_group").alias("groups"))
    rows = per_event.join(groups, "event_id").withColumn("weight", half_life(age_days(F.col("at"), as_of), half))
    return rows.groupBy("source_id").agg(F.count("*").alias("sample_size"), _weighted(F.col("withdrawn")).alias("withdrawn_share"), _weighted(F.col("groups") > 1).alias("corroborated_share"))


def message_metrics(archive: DataFrame, sources: DataFrame, as_of: datetime, days: int = WINDOW_DAYS, half: float = HALF_LIFE_DAYS) -> DataFrame:
    """(source_id, unreadable_share, first_reports, lag_median_seconds). A group speaks when its first source does, and an
    event's leader is its first group; ties by source id."""
    groups = sources.select(F.col("id").alias("source_id"), F.col("independence_group").alias("g"))
    base = archive.where(F.col("published_at") >= instant(as_of - timedelta(days=days))).join(groups, "source_id", "left")
    base = base.select("source_id", "event_id", "published_at", "decision", F.coalesce("g", "source_id").alias("independence_group"), half_life(age_days(F.col("published_at"), as_of), half).alias("weight"))
    readable = base.groupBy("source_id").agg(_weighted(F.col("decision").isin("ignored", "unrecognized")).alias("unreadable_share"))
    spoke = F.struct("published_at", "source_id")
    group_first = base.where(F.col("event_id").isNotNull()).groupBy("event_id", "independence_group").agg(F.min(spoke).alias("f"))
    leader = group_first.groupBy("event_id").agg(F.min("f").alias("l"))
    led = leader.groupBy(F.col("l.source_id").alias("source_id")).agg(F.count("*").alias("first_reports"))
    behind = group_first.join(leader, "event_id").select(F.col("f.source_id").alias("source_id"), seconds_between(F.col("l.published_at"), F.col("f.published_at")).alias("lag"))
    lags = behind.where("lag > 0").groupBy("source_id").agg(F.percentile("lag", F.lit(0.5)).alias("lag_median_seconds"))
    return readable.join(led, "source_id", "left").join(lags, "source_id", "left").select("source_id", "unreadable_share", F.coalesce("first_reports", F.lit(0)).alias("first_reports"), "lag_median_seconds")


def trust_score(metrics: DataFrame) -> DataFrame:
    """metrics with trust, neutral and official_floor_applied. Columns: withdrawn_share, corroborated_share, first_reports,
    lag_median_seconds, unreadable_share, sample_size, official."""
    part = lambda c: rounded(clamp(F.coalesce(F.col(c), F.lit(0.0)), 0, 1))
    size = F.coalesce(F.col("sample_size"), F.lit(0))
    lag = rounded(F.greatest(F.col("lag_median_seconds"), F.lit(0.0)), 1)
    lead = clamp(F.coalesce(F.col("first_reports"), F.lit(0)) / size, 0, 1)
    speed = F.when(F.col("lag_median_seconds").isNull(), F.lit(NEUTRAL)).otherwise(clamp(1 - lag / LAG_REFERENCE_SECONDS, 0, 1))
    measured = clamp(WEIGHTS["withdrawn"] * (1 - part("withdrawn_share")) + WEIGHTS["corroborated"] * part("corroborated_share") + WEIGHTS["lead"] * lead + WEIGHTS["lag"] * speed + WEIGHTS["unreadable"] * (1 - part("unreadable_share")), 0, 1)
    enough = size >= LEAST_SAMPLE
    out = metrics.withColumn("measured", F.when(enough, measured))
    floored = F.when(F.col("official"), F.greatest(F.col("measured"), F.lit(NEUTRAL))).otherwise(F.col("measured"))
    return out.select("*", F.when(enough, rounded(floored, 3)).otherwise(F.lit(NEUTRAL)).alias("trust"), (~enough).alias("neutral"), (enough & F.col("official") & (F.col("measured") < NEUTRAL)).alias("official_floor_applied")).drop("measured")


def trust_modifier(trust: Column) -> Column:
    """From 0.6 at no trust over 1 at neutral to 1.2 at full trust; 1 where nothing is measured."""
    v = clamp(trust.cast("double"), 0, 1)
    raw = F.when(v <= NEUTRAL, FLOOR + (1 - FLOOR) * (v / NEUTRAL)).otherwise(1 + (CEILING - 1) * ((v - NEUTRAL) / (1 - NEUTRAL)))
    return F.when(trust.isNull() | F.isnan(trust.cast("double")), F.lit(1.0)).otherwise(rounded(clamp(raw, FLOOR, CEILING)))


def trust_label(trust: Column) -> Column:
    return F.when(trust >= HIGH_FROM, F.lit("high")).when(trust <= REDUCED_TO, F.lit("reduced")).when(trust.isNotNull(), F.lit("usual"))


def latest(history: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order names every tie-break."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
