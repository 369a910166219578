"""The way that reports of an event describe: places in order, the legs between them, and what the whole rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import count_where
from ..functions.timeops import seconds_between

#: Kinds of places, the most specific first, and bases of a leg, the weakest first.
SPECIFIC = ("city", "special_city", "hromada", "raion", "oblast", "country")
BASES = ("observation_sequence", "reported_direction", "reported_transit")


def _most_specific(when: Column) -> Column:
    """Of a report's rows the place that says most, ties by id."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(t) for t in SPECIFIC)), F.col("type")), F.lit(0))
    order = F.when(when, F.struct(F.when(rank > 0, rank).otherwise(99), F.col("location_id")))
    return F.min_by(F.when(when, F.struct("location_id", F.col("lat").isNotNull() & F.col("lon").isNotNull())), order)


def positions(rows: DataFrame) -> DataFrame:
    """(event_id, report_id, at, offset, basis, location_id, located, source_id, independence_group, tier, official, threat_type)
    of reports' rows (event_id, report_id, at, redirect, role, relation, location_id, type, lat, lon, source_id,
    independence_group, tier, official, threat_type): one or two places that a report puts the target at, in order.

    A redirect that names a place passed and one ahead gives both, as a transit; a report with a place and a heading both, as
    a direction; else the heading, the place or what was passed. All rows of a report have one time and source."""
    asserted, heading = F.col("role") == "asserted", F.col("relation") == "reported_direction"
    passed, ahead, anchor = (_most_specific(w).alias(n) for w, n in ((F.col("role") == "retracted", "passed"), (asserted & heading, "ahead"), (asserted & ~heading, "anchor")))
    own = [F.first(c, ignorenulls=True).alias(c) for c in ("source_id", "independence_group", "tier", "official", "threat_type")]
    each = rows.groupBy("event_id", "report_id").agg(F.min("at").alias("at"), F.max("redirect").alias("redirect"), passed, ahead, anchor, *own)
    both = lambda a, b, basis: F.struct(F.array(a, b).alias("places"), F.lit(basis).alias("basis"))
    one = lambda a: F.struct(F.array(a).alias("places"), F.lit(BASES[0]).alias("basis"))
    p, a, h = F.col("passed"), F.col("anchor"), F.col("ahead")
    step = F.when(F.col("redirect") & p.isNotNull() & h.isNotNull(), both(p, h, BASES[2])).when(a.isNotNull() & h.isNotNull(), both(a, h, BASES[1])).when(F.coalesce(h, a, p).isNotNull(), one(F.coalesce(h, a, p)))
    spread = each.withColumn("step", step).where(F.col("step").isNotNull()).select("*", F.posexplode("step.places").alias("offset", "place"))
    names = [n for n in ("source_id", "independence_group", "tier", "official", "threat_type")]
    return spread.select("event_id", "report_id", "at", "offset", F.col("step.basis").alias("basis"), F.col("place")["location_id"].alias("location_id"), F.col("place")["col2"].alias("located"), *names)


def legs(rows: DataFrame) -> DataFrame:
    """A row for each change of place along an event's positions: from_id, to_id, basis, seconds, evidence, independent,
    drawable, threat_type. From one report to the next it is a sequence of observations, within a report its own basis, with
    no time between. Its ends are independent if their sources' groups differ; two such of tiers A or B confirm it, unless the
    later source is official. Reports are in order of time, ties by id."""
    order = Window.partitionBy("event_id").orderBy("at", "report_id", "offset")
    before = {c: F.lag(c).over(order) for c in ("location_id", "located", "at", "independence_group", "tier")}
    rows = rows.withColumns({f"_{c}": x for c, x in before.items()}).where(F.col("_location_id").isNotNull() & (F.col("_location_id") != F.col("location_id")))
    between = F.col("offset") == 0
    independent = between & (F.col("_independence_group") != F.col("independence_group"))
    seconds = F.when(between, F.greatest(F.round(seconds_between(F.col("_at"), F.col("at"))).cast("long"), F.lit(0))).otherwise(F.lit(0))
    known = F.col("tier").isin("A", "B") & F.col("_tier").isin("A", "B")
    evidence = F.when(F.col("official"), "official").when(independent & known, "confirmed").when(F.col("tier") == "B", "monitoring").otherwise("unverified")
    return rows.select(
        "event_id", "report_id", "at", "offset", F.col("_location_id").alias("from_id"), F.col("location_id").alias("to_id"), F.when(between, F.lit(BASES[0])).otherwise(F.col("basis")).alias("basis"),
        seconds.alias("seconds"), evidence.alias("evidence"), F.coalesce(independent, F.lit(False)).alias("independent"), (F.col("_located") & F.col("located")).alias("drawable"), "threat_type",
    )


def reported_vectors(rows: DataFrame) -> DataFrame:
    """(event_id, nodes, legs, drawable_legs, sources, independence_groups, strongest_basis, confirmed_legs, first_at, last_at,
    seconds) of each event with reports that place it; rows as for positions()."""
    at = positions(rows)
    whole = at.groupBy("event_id").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("independence_group").alias("independence_groups"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    strength = F.array_position(F.array(*(F.lit(b) for b in BASES)), F.col("basis"))
    own = legs(at).groupBy("event_id").agg(F.count("*").alias("legs"), count_where(F.col("drawable")).alias("drawable_legs"), count_where(F.col("evidence") == "confirmed").alias("confirmed_legs"), F.max_by("basis", strength).alias("strongest_basis"))
    out = whole.join(own, "event_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("event_id", (n("legs") + 1).alias("nodes"), n("legs").alias("legs"), n("drawable_legs").alias("drawable_legs"), "sources", "independence_groups", "strongest_basis", n("confirmed_legs").alias("confirmed_legs"), "first_at", "last_at", seconds_between(F.col("first_at"), F.col("last_at")).cast("long").alias("seconds"))
