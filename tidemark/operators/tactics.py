"""Detectors of change between the current day and the baseline before it.

Each takes a small aggregate (class, region, hour, corridor or wave rows) and gives detections
(code, subject, current, baseline, effect); they are merged, ranked and digested at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import clock_distance, rounded, share

BASELINE_DAYS = 14
LEAST_SUPPORT, MIX_SHIFT, MOST_MIX = 5, 0.15, 4
MOST_NEW, NEW_REGION_SUPPORT = 3, 3
NIGHT_SHIFT, BAND_HOURS, BAND_SHARE = 0.20, 3, 0.25
CONCENTRATION = 0.20
DURATION_CHANGE, WAVES_EACH, WAVES_A_DAY = 0.40, 3, 1.0
CORRIDOR_SUPPORT = 3
LEAST_CURRENT, LEAST_BASELINE = 12, 20
#: Fixed order of the kinds.
ORDER = ("new_weapon_class", "weapon_mix_shift", "launch_hour_shift", "territory_expansion", "territory_concentration", "wave_cadence_change", "redirect_corridor")


def _detections(rows: DataFrame, code: str, subject: str, effect, most: int | None = None) -> DataFrame:
    out = rows.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"), F.col("current").cast("double").alias("current"), F.col("baseline").cast("double").alias("baseline"), rounded(effect).alias("effect"))
    return out if most is None else out.orderBy(F.desc(F.abs("effect")), F.desc("current"), "subject").limit(most)


def _shared(rows: DataFrame) -> DataFrame:
    whole = Window.partitionBy()  # classes or regions: a few dozen rows
    return rows.select("*", share(F.col("current"), F.sum("current").over(whole)).alias("cs"), share(F.col("baseline"), F.sum("baseline").over(whole)).alias("bs"))


def weapon_mix_shift(classes: DataFrame) -> DataFrame:
    delta = F.col("cs") - F.col("bs")
    rows = _shared(classes).where((F.greatest("current", "baseline") >= LEAST_SUPPORT) & (F.abs(delta) >= MIX_SHIFT))
    return _detections(rows, "weapon_mix_shift", "threat_type", delta, MOST_MIX)


def new_weapon_class(classes: DataFrame) -> DataFrame:
    return _detections(classes.where((F.col("baseline") == 0) & (F.col("current") >= LEAST_SUPPORT)), "new_weapon_class", "threat_type", F.col("current"), MOST_NEW)


def territory_expansion(regions: DataFrame) -> DataFrame:
    return _detections(regions.where((F.col("baseline") == 0) & (F.col("current") >= NEW_REGION_SUPPORT)), "territory_expansion", "region_id", F.col("current"), MOST_NEW)


def territory_concentration(regions: DataFrame) -> DataFrame:
    """The region with the most messages now, if its share has moved."""
    delta = F.col("cs") - F.col("bs")
    first = _shared(regions).orderBy(F.desc("current"), "region_id").limit(1)
    return _detections(first.where((F.col("current") >= LEAST_SUPPORT) & (F.abs(delta) >= CONCENTRATION)), "territory_concentration", "region_id", delta)


def hour_profile(hours: DataFrame) -> DataFrame:
    """One row: night shares and modal bands (start, share) of both windows."""
    night = F.col("hour").isin(22, 23, 0, 1, 2, 3, 4, 5)
    both = hours.agg(*(share(F.sum(F.when(night, F.col(c)).otherwise(0)), F.sum(c)).alias(f"{c}_night") for c in ("current", "baseline")), F.sum("current").alias("current_all"), F.sum("baseline").alias("baseline_all"))
    spread = hours.select(F.explode(F.array(*((F.col("hour") - i + 24) % 24 for i in range(BAND_HOURS)))).alias("start"), "current", "baseline").groupBy("start").agg(F.sum("current").alias("current"), F.sum("baseline").alias("baseline"))
    best = spread.agg(*(F.min_by("start", F.struct(-F.col(c), F.col("start"))).alias(f"{c}_band") for c in ("current", "baseline")), *(F.max(c).alias(f"{c}_most") for c in ("current", "baseline")))
    return both.crossJoin(best)  # two single rows


def launch_hour_shift(hours: DataFrame) -> DataFrame:
    p = hour_profile(hours)
    night = F.col("current_night") - F.col("baseline_night")
    moved = clock_distance(F.col("current_band"), F.col("baseline_band"))
    strong = F.least(share(F.col("current_most"), F.col("current_all")), share(F.col("baseline_most"), F.col("baseline_all")))
    by_night = p.where(F.abs(night) >= NIGHT_SHIFT).select(F.lit("night").alias("subject"), F.col("current_night").alias("current"), F.col("baseline_night").alias("baseline"), night.alias("e"))
    by_band = p.where((moved >= BAND_HOURS) & (strong >= BAND_SHARE)).select(F.lit("band").alias("subject"), F.col("current_band").alias("current"), F.col("baseline_band").alias("baseline"), moved.cast("double").alias("e"))
    return _detections(by_night.unionByName(by_band), "launch_hour_shift", "subject", F.col("e"))


def wave_cadence_change(current: DataFrame, baseline: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """From waves() of both windows: the median duration, and waves a day."""
    side = lambda w, p: w.agg(F.count("*").alias(f"{p}_n"), F.percentile("seconds", F.lit(0.5)).alias(f"{p}_median"))
    both = side(current, "c").crossJoin(side(baseline, "b"))  # two single rows
    change = (F.col("c_median") - F.col("b_median")) / F.col("b_median")
    longer = both.where((F.col("c_n") >= WAVES_EACH) & (F.col("b_n") >= WAVES_EACH) & (F.col("b_median") > 0) & (F.abs(change) >= DURATION_CHANGE))
    rate = F.col("c_n") - F.col("b_n") / days
    oftener = both.where((F.col("c_n") + F.col("b_n") > 0) & (F.abs(rate) >= WAVES_A_DAY))
    rows = longer.select(F.lit("duration").alias("subject"), F.col("c_median").alias("current"), F.col("b_median").alias("baseline"), change.alias("e"))
    rows = rows.unionByName(oftener.select(F.lit("frequency").alias("subject"), F.col("c_n").cast("double").alias("current"), (F.col("b_n") / days).alias("baseline"), rate.alias("e")))
    return _detections(rows, "wave_cadence_change", "subject", F.col("e"))


def corridors(messages: DataFrame, bridge: DataFrame, regions: DataFrame) -> DataFrame:
    """(from_id, to_id, current, baseline): messages that withdraw one region and assert another."""
    placed = bridge.join(regions, "location_id").select(F.col("classification_id").alias("id"), "role", "region_id").distinct()
    side = lambda role, name: placed.where(F.col("role") == role).select("id", F.col("region_id").alias(name))
    pairs = side("retracted", "from_id").join(side("asserted", "to_id"), "id").where("from_id <> to_id")
    rows = messages.select("id", "now").join(pairs, "id")
    return rows.groupBy("from_id", "to_id").agg(F.count(F.when(F.col("now"), 1)).alias("current"), F.count(F.when(~F.col("now"), 1)).alias("baseline"))


def redirect_corridor(rows: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    usual = F.col("baseline") / days
    found = rows.where((F.col("current") >= CORRIDOR_SUPPORT) & (usual <= F.col("current") / 2)).withColumn("subject", F.concat_ws(">", "from_id", "to_id"))
    return _detections(found, "redirect_corridor", "subject", F.col("current") - usual, MOST_NEW)


def merged(detections: DataFrame, current_messages: int, baseline_messages: int) -> DataFrame:
    """All detections in their fixed order with a rank; none of a thin day, only the new ones over a thin baseline."""
    keep = F.lit(current_messages >= LEAST_CURRENT)
    if baseline_messages < LEAST_BASELINE:
        keep = keep & F.col("code").startswith("new_")
    kind = F.array_position(F.array(*(F.lit(c) for c in ORDER)), F.col("code"))
    order = Window.partitionBy().orderBy(kind, F.desc(F.abs("effect")), "subject")  # a few dozen rows
    return detections.where(keep).withColumn("rank", F.row_number().over(order))


def digest(ranked: DataFrame) -> DataFrame:
    """One row: SHA-256 of the detections; a pass with the digest of the last one confirms it instead of repeating it."""
    line = F.concat_ws("|", F.lpad(F.col("rank").cast("string"), 4, "0"), "code", "subject", F.format_string("%.4f", "effect"))
    return ranked.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("detections"))
