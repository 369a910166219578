"""Outcomes, agreement and coverage: how claims turned out, where verdicts differ, what is seen where."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import count_where, rounded, share
from ..functions.timeops import instant, seconds_between

THRESHOLDS = (0.85, 0.9, 0.95)


def precision_by_threshold(outcomes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A row for each threshold over the outcomes with at least that confidence; what was undecidable is no denominator.

    Each row goes to the thresholds it reaches inside its task and counts combine there, so there is no theta join."""
    every = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = outcomes.withColumn("threshold", F.explode(F.filter(every, lambda t: t <= F.col("confidence"))))
    is_ = lambda *names: F.col("outcome").isin(*names)
    undecidable = is_("unconfirmed") & F.col("alert_active")
    lead = F.when(F.col("confirmed_at").isNotNull(), seconds_between(F.col("published_at"), F.col("confirmed_at")))
    counted = rows.groupBy("threshold").agg(F.count("*").alias("promotions"), count_where(is_("confirmed_official")).alias("official"), count_where(is_("confirmed_independent")).alias("independent"), count_where(is_("unconfirmed")).alias("unconfirmed"), count_where(undecidable).alias("undecidable"), F.percentile(lead, F.lit(0.5)).alias("median_lead_seconds"))
    spine = outcomes.sparkSession.range(1).select(F.explode(every).alias("threshold"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = spine.join(counted, "threshold", "left").select("threshold", *(zero(c) for c in ("promotions", "official", "independent", "unconfirmed", "undecidable")), "median_lead_seconds")
    decidable = F.col("promotions") - F.col("undecidable")
    return out.withColumn("precision", F.when(decidable > 0, rounded((F.col("official") + F.col("independent")) / decidable)))


def first_corroboration(claims: DataFrame) -> DataFrame:
    """(event_id, first_group, corroborating_group, seconds): the first claim of an event, and the earliest later one of
    another independence group."""
    first = claims.groupBy("event_id", "independence_group").agg(F.min("asserted_at").alias("at"))
    leader = first.groupBy("event_id").agg(F.min(F.struct("at", "independence_group")).alias("l"))
    later = first.join(leader, "event_id").where((F.col("independence_group") != F.col("l.independence_group")) & (F.col("at") > F.col("l.at")))
    return later.groupBy("event_id", F.col("l.independence_group").alias("first_group"), F.col("l.at").alias("t0")).agg(F.min(F.struct("at", "independence_group")).alias("c")).select("event_id", "first_group", F.col("c.independence_group").alias("corroborating_group"), seconds_between(F.col("t0"), F.col("c.at")).cast("long").alias("seconds"))


def active_at(instants: DataFrame, periods: DataFrame) -> DataFrame:
    """(id, active): how many periods [started_at, ended_at) of its place hold each instant (id, location_id, at)."""
    p = periods.select("location_id", "started_at", "ended_at")
    hit = instants.join(p, "location_id").where((F.col("started_at") <= F.col("at")) & (F.col("ended_at").isNull() | (F.col("at") < F.col("ended_at"))))
    counts = hit.groupBy("id").agg(F.count("*").alias("active"))
    return instants.select("id").join(counts, "id", "left").select("id", F.coalesce("active", F.lit(0)).alias("active"))


def disagreement(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, differing, compared, agreement_percent) of pairs with columns a_<field> and b_<field>; field `any` says
    whether the verdicts differ anywhere."""
    differs = {f: ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields}
    anywhere = F.lit(False)
    for d in differs.values():
        anywhere = anywhere | d
    sums = pairs.agg(F.count("*").alias("n"), *(F.count_if(d).alias(f) for f, d in {**differs, "any": anywhere}.items()))
    rows = sums.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("differing")) for f in [*fields, "any"]))).alias("x"))
    return rows.select("x.field", "x.differing", F.col("n").alias("compared"), rounded(share(F.col("n") - F.col("x.differing"), F.col("n")) * 100, 1).alias("agreement_percent"))


def coverage_matrix(messages: DataFrame, regions: DataFrame, at: datetime, hours: int) -> DataFrame:
    """A row for each region: covering sources and messages in the last hours and the last day; zero where nothing came."""
    recent = messages.where((F.col("published_at") > instant(at - timedelta(days=1))) & (F.col("published_at") <= instant(at)))
    late = F.col("published_at") > instant(at - timedelta(hours=hours))
    seen = recent.groupBy("region_id").agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("messages_day"), count_where(late).alias("messages_recent"), count_where(F.col("created_event")).alias("events_raised"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return regions.select(F.col("id").alias("region_id"), "name").join(seen, "region_id", "left").select("region_id", "name", *(zero(c) for c in ("sources", "messages_day", "messages_recent", "events_raised")))


def prior_context(messages: DataFrame, seconds: int, n: int) -> DataFrame:
    """(id, prior): how many messages the same source sent within the seconds before, n at most (those that a reader of
    the context is shown). Messages are counted by source and second first, and only these counts are ordered."""
    rows = messages.select("id", "source_id", F.unix_seconds("published_at").alias("s"))
    # the difference of two running sums: a frame with both ends moving would be added up anew for each row
    upto = lambda end: F.coalesce(F.sum("own").over(Window.partitionBy("source_id").orderBy("s").rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    before = F.when(F.col("s").isNull(), F.col("own")).otherwise(upto(-1) - upto(-seconds - 1))
    counts = rows.groupBy("source_id", "s").agg(F.count("*").alias("own")).select("source_id", "s", F.least(before, F.lit(n)).alias("prior"))
    return rows.join(counts, (rows["source_id"].eqNullSafe(counts["source_id"])) & (rows["s"].eqNullSafe(counts["s"]))).select("id", "prior")


def withdrawal_candidates(events: DataFrame, evidence: DataFrame, before: datetime, n: int = 50) -> DataFrame:
    """Live, unverified events of the model, old enough and without evidence of anyone else; the oldest n."""
    others = evidence.where(F.col("origin") != "model").select("event_id")
    own = events.where((F.col("origin") == "model") & (F.col("status") == "active") & (F.col("evidence_level") == "unverified") & (F.col("created_at") < instant(before)))
    return own.join(others, "event_id", "left_anti").orderBy("created_at", "event_id").limit(n)


def poisson_estimate(gaps: DataFrame, horizon_days: int) -> DataFrame:
    """Of (key, days): the rate of recurrence, the chance of a day with one, and what the horizon may bring."""
    means = gaps.where(F.col("days") >= 0).groupBy("key").agg(F.avg("days").alias("mean"), F.count("*").alias("gaps")).where("mean > 0")
    rate = F.lit(1.0) / F.col("mean")
    expected = rate * horizon_days
    p = 1 - F.exp(-rate)
    level = F.when(rounded(p) >= 0.6, F.lit("high")).when(rounded(p) >= 0.3, F.lit("medium")).otherwise(F.lit("low"))
    return means.select("key", "gaps", rounded(F.col("mean"), 3).alias("mean_days"), rounded(rate).alias("rate"), rounded(p).alias("p_daily"), rounded(expected, 2).alias("expected"), rounded(F.greatest(expected - F.sqrt(expected), F.lit(0.0)), 2).alias("low"), rounded(expected + F.sqrt(expected), 2).alias("high"), level.alias("level"))
