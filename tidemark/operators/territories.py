"""The state of territories from alerts, live and expected threats, and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .places import COVERAGES, EVIDENCE, RELATIONS, rank

#: Kinds of places with an outline, relations that assert, evidence that confirms, times from the nearest on, and
#: levels of risk from the lowest on.
OUTLINED = ("oblast", "special_city", "raion")
ASSERTING = ("explicit_threat", "reported_direction", "aftermath")
CONFIRMING = ("official", "confirmed")
TIMINGS = ("now", "within_hour", "evening", "within_day", "within_two_days")
LEVELS = ("background", "elevated", "significant", "high", "very_high")
MOST_EXPECTED = 6


def reach(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(location_id, territory_id, coverage): the outlined places at and above each place. One with an outline covers itself
    directly; the first outlined place above one without stands for it (unmapped); those further up are covered in part.
    Countries reach nothing."""
    kinds = nodes.where(F.col("type") != "country").select(F.col("id").alias("location_id"))
    outlined = nodes.where(F.col("type").isin(*OUTLINED)).select(F.col("id").alias("territory_id"))
    up = tree.select(F.col("descendant_id").alias("location_id"), F.col("ancestor_id").alias("territory_id"), "depth")
    rows = up.join(outlined, "territory_id").join(kinds, "location_id", "left_semi")
    first = F.col("depth") == F.min("depth").over(Window.partitionBy("location_id"))  # a few rows a place
    coverage = F.when(F.col("depth") == 0, "direct").when(first, "unmapped").otherwise("partial")
    return rows.select("location_id", "territory_id", coverage.alias("coverage"))


def composed_states(nodes: DataFrame, tree: DataFrame, alerts: DataFrame, threats: DataFrame, assessments: DataFrame) -> DataFrame:
    """A row for each territory that any source reaches: coverage (the strongest), alerts, alert_since, threats (array of
    struct<threat_type, relation, evidence, coverage, events, asserted, consequence>, by class), threat_active, consequences,
    expected (ids of the next MOST_EXPECTED threats, by time and then probability), assessment_id, threat_type and risk_level of
    the strongest assessment, and analytic (its level, if above background, else none).

    alerts: (id, location_id, started_at); threats: (event_id, location_id, threat_type, relation, evidence, timing,
    probability), of which those with a timing but `now` are expected; assessments: (id, location_id, threat_type, risk_level,
    risk_score). A place that an event names in several ways counts once, with the strongest; an aftermath with confirming
    evidence is a consequence. Of equal scores the higher level, then the smaller id is stronger. Sources are summed up by
    territory and event before they meet, and only expected threats are ranked, limited before they are shuffled."""
    up = reach(nodes, tree)
    word = lambda c, order: F.get(F.array(*(F.lit(x) for x in order)), F.col(c) - 1)
    covered = lambda df: df.join(up, "location_id").withColumn("c", rank(F.col("coverage"), COVERAGES))

    a = covered(alerts).groupBy("territory_id").agg(F.max("c").alias("c"), F.count("*").alias("alerts"), F.min("started_at").alias("alert_since"))

    later = F.col("timing").isNotNull() & (F.col("timing") != "now")
    now = covered(threats.where(~F.coalesce(later, F.lit(False))))
    aftermath = (F.col("relation") == "aftermath") & F.col("evidence").isin(*CONFIRMING)
    each = now.groupBy("territory_id", "threat_type", "event_id").agg(F.max("c").alias("c"), F.max(rank(F.col("relation"), RELATIONS)).alias("r"), F.max(rank(F.col("evidence"), EVIDENCE)).alias("e"), F.max(aftermath).alias("consequence"))
    classes = each.groupBy("territory_id", "threat_type").agg(F.max("c").alias("c"), F.max("r").alias("r"), F.max("e").alias("e"), F.count("*").alias("events"), F.max("consequence").alias("consequence"))
    classes = classes.withColumn("relation", word("r", RELATIONS)).withColumn("asserted", F.col("relation").isin(*ASSERTING))
    shown = F.struct("threat_type", "relation", word("e", EVIDENCE).alias("evidence"), word("c", COVERAGES).alias("coverage"), "events", "asserted", "consequence")
    # a territory has as many rows here as there are classes
    t = classes.groupBy("territory_id").agg(F.max("c").alias("c"), F.array_sort(F.collect_list(shown)).alias("threats"), F.max("asserted").alias("threat_active"), F.max("consequence").alias("consequences"))

    ahead = covered(threats.where(later)).groupBy("territory_id", "event_id").agg(F.max("c").alias("c"), F.min(rank(F.col("timing"), TIMINGS)).alias("t"), F.max(F.coalesce("probability", F.lit(0.0))).alias("p"))
    order = Window.partitionBy("territory_id").orderBy("t", F.desc("p"), "event_id")
    listed = ahead.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_EXPECTED).groupBy("territory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"]).alias("expected"))
    e = ahead.groupBy("territory_id").agg(F.max("c").alias("c")).join(listed, "territory_id")

    scored = covered(assessments).withColumn("level", rank(F.col("risk_level"), LEVELS))
    # one assessment a territory: the best score and level, and of these the smallest id
    top = scored.groupBy("territory_id", "risk_score", "level").agg(F.max("c").alias("c"), F.min(F.struct(F.col("id").alias("assessment_id"), F.col("threat_type").alias("assessed_type"), "risk_level")).alias("a"))
    s = top.groupBy("territory_id").agg(F.max("c").alias("c"), F.max_by("a", F.struct("risk_score", "level")).alias("a")).select("territory_id", "c", "a.*")

    out = a.withColumnRenamed("c", "c1").join(t.withColumnRenamed("c", "c2"), "territory_id", "full_outer").join(e.withColumnRenamed("c", "c3"), "territory_id", "full_outer").join(s.withColumnRenamed("c", "c4"), "territory_id", "full_outer")
    out = out.withColumn("c", F.greatest("c1", "c2", "c3", "c4"))
    some = lambda c, other: F.coalesce(F.col(c), other).alias(c)
    analytic = F.when(rank(F.col("risk_level"), LEVELS) > 1, F.col("risk_level")).otherwise("none")
    return out.select("territory_id", word("c", COVERAGES).alias("coverage"), some("alerts", F.lit(0)), "alert_since", some("threats", F.array().cast(t.schema["threats"].dataType)), some("threat_active", F.lit(False)), some("consequences", F.lit(False)), some("expected", F.array().cast(listed.schema["expected"].dataType)), "assessment_id", F.col("assessed_type").alias("threat_type"), "risk_level", analytic.alias("analytic"))
