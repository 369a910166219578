"""Report rows: icons of a territory, delayed messages, runs, admissions and outcomes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import count_where
from ..functions.timeops import instant, local, seconds_between

MOST_TERRITORIES, MOST_ICONS = 20, 3


def without_broad_pairs(states: DataFrame, most: int = MOST_TERRITORIES) -> DataFrame:
    """states (territory_id, threat_type, level) less the pairs of class and level that hold in more than `most` territories."""
    broad = states.groupBy("threat_type", "level").agg(F.count_distinct("territory_id").alias("_n")).where(F.col("_n") > most)
    return states.join(broad, ["threat_type", "level"], "left_anti")


def ranked_icons(icons: DataFrame, order: list[Column], n: int = MOST_ICONS) -> DataFrame:
    """The first n icons of each territory with their rank, and how many did not fit."""
    total = icons.groupBy("territory_id").agg(F.count("*").alias("_all"))
    ranked = icons.withColumn("rank", F.row_number().over(Window.partitionBy("territory_id").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.join(total, "territory_id").withColumn("overflow", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def downtime_summary(messages: DataFrame, ceiling_minutes: int) -> DataFrame:
    """Of messages read the ceiling or longer after they were published, each (source, instant) once: a row for each place
    and class with its messages, the first and the last of them."""
    late = messages.where(seconds_between(F.col("published_at"), F.col("classified_at")) >= ceiling_minutes * 60)
    once = late.groupBy("location_id", "threat_type", "source_id", "published_at").agg(F.lit(1).alias("one"))
    return once.groupBy("location_id", "threat_type").agg(F.count("*").alias("messages"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def run_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each key: how many, how many failed, the first and the last instant, and the last one's status."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), count_where(F.col("status") == "failed").alias("failed"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("status", F.struct("at", "id")).alias("last_status"))


def status_histogram(rows: DataFrame) -> DataFrame:
    """One row: a map from status to rows."""
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def admissions(requests: DataFrame, done: DataFrame, at: datetime, enabled: bool, daily_cap: int, cooldown_seconds: int) -> DataFrame:
    """requests (key) with verdict and wait_seconds: disabled, then the cap of the local day, then the key's cooldown."""
    today = done.where(F.to_date(local(F.col("at"))) == F.to_date(local(instant(at)))).agg(F.count("*").alias("_today"))
    last = done.where(F.col("at") <= instant(at)).groupBy("key").agg(F.max("at").alias("_last"))
    rows = requests.join(last, "key", "left").join(F.broadcast(today), F.lit(True))  # today is one row
    wait = F.ceil(F.lit(float(cooldown_seconds)) - seconds_between(F.col("_last"), instant(at)))
    verdict = F.when(~F.lit(enabled), F.lit("disabled")).when(F.col("_today") >= daily_cap, F.lit("daily_cap")).when(wait > 0, F.lit("cooldown")).otherwise(F.lit("admitted"))
    return rows.select(*requests.columns, verdict.alias("verdict"), F.when(verdict == "cooldown", wait.cast("long")).alias("wait_seconds"))


def outcomes(promotions: DataFrame, alerts: DataFrame, claims: DataFrame, window_seconds: int) -> DataFrame:
    """(event_id, outcome, confirmed_seconds): an official alert at the same place within [published, + window], else a claim
    of another independence group on the event in that time, else unconfirmed."""
    until = F.col("published_at") + F.make_dt_interval(secs=F.lit(window_seconds))
    p = promotions.select("event_id", "location_id", "published_at", F.col("independence_group").alias("own_group"), until.alias("until"))
    alert = p.join(alerts.select("location_id", F.col("started_at").alias("t")), "location_id").where(F.col("t").between(F.col("published_at"), F.col("until")))
    other = p.join(claims.select("event_id", "independence_group", F.col("asserted_at").alias("t")), "event_id").where((F.col("independence_group") != F.col("own_group")) & F.col("t").between(F.col("published_at"), F.col("until")))
    first = lambda rows, name: rows.groupBy("event_id").agg(F.min("t").alias(name))
    joined = p.join(first(alert, "official_at"), "event_id", "left").join(first(other, "independent_at"), "event_id", "left")
    outcome = F.when(F.col("official_at").isNotNull(), F.lit("confirmed_official")).when(F.col("independent_at").isNotNull(), F.lit("confirmed_independent")).otherwise(F.lit("unconfirmed"))
    return joined.select("event_id", outcome.alias("outcome"), seconds_between(F.col("published_at"), F.coalesce("official_at", "independent_at")).cast("long").alias("confirmed_seconds"))
