"""Slices of the classification archive. Series are kept apart by classifier version and never mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import count_where, rounded, share
from ..functions.timeops import in_window, local_bucket, seconds_between, within
from ..params import AnalyticsWindow

ASSERTING = ("event_created", "event_merged", "redirect")
NATIONAL = "ua"


def attributed(base: DataFrame, bridge: DataFrame, regions: DataFrame) -> DataFrame:
    """base with region_id: one row for each message (of an id of its own) and region it names, `ua` for a national message
    that names a place without a region or none. Regions of a message meet as a set, so that no wide row is made distinct."""
    placed = bridge.where(F.col("role") == "asserted").join(regions, "location_id", "left")
    sets = placed.groupBy(F.col("classification_id").alias("id")).agg(F.collect_set(F.coalesce("region_id", F.lit(""))).alias("_regions"))
    rows = base.join(sets, "id", "left").select(*(F.col(c) for c in base.columns), F.explode_outer("_regions").alias("_region"))
    region = F.coalesce(F.when(F.col("_region") != "", F.col("_region")), F.when(F.col("national_scope"), F.lit(NATIONAL)))
    return rows.select(*(F.col(c) for c in base.columns), region.alias("region_id"))


def threat_dynamics(archive: DataFrame, bridge: DataFrame, locations: DataFrame, regions: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Messages, events raised and distinct events by local bucket, version and class; in total and by region."""
    bucket = local_bucket(F.col("published_at"), window.bucket, window.zone).cast("string")
    base = archive.where(in_window(window) & F.col("decision").isin(*ASSERTING)).select("id", "classifier_version", bucket.alias("bucket"), "created_event", "event_id", "national_scope", F.coalesce("threat_type", F.lit("unknown")).alias("threat_type"))
    counts = (F.count("*").alias("messages"), count_where(F.col("created_event")).alias("events_raised"), F.count_distinct("event_id").alias("events"))
    total = base.groupBy("bucket", "classifier_version", "threat_type").agg(*counts).select(F.lit("total").alias("scope"), F.lit(None).cast("string").alias("region_id"), F.lit(None).cast("string").alias("region_name"), "bucket", "classifier_version", "threat_type", "messages", "events_raised", "events")
    names = locations.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    placed = attributed(base, bridge, regions).where(F.col("region_id").isNotNull())
    if window.region_id is not None:
        placed = placed.where(F.col("region_id") == window.region_id)
    by_region = placed.groupBy("region_id", "bucket", "classifier_version", "threat_type").agg(*counts).join(names, "region_id").withColumn("scope", F.lit("oblast"))
    return by_region.select(*total.columns) if window.region_id is not None else total.unionByName(by_region.select(*total.columns))


def without_geography(archive: DataFrame, bridge: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """How many asserting, non-national messages name no place."""
    base = archive.where(in_window(window) & F.col("decision").isin(*ASSERTING) & ~F.col("national_scope"))
    placed = bridge.where(F.col("role") == "asserted").select(F.col("classification_id").alias("id"))
    return base.join(placed, "id", "left_anti").agg(F.count("*").alias("messages"))


def _rank(events: str, alias: str) -> Column:
    order = Window.partitionBy("classifier_version").orderBy(F.desc(events), F.asc("region_id"))
    return F.when(F.col(events) > 0, F.row_number().over(order)).alias(alias)


def geography_shift(archive: DataFrame, bridge: DataFrame, locations: DataFrame, regions: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Each region's messages and events now and in the adjacent window before, with shares and ranks within a version."""
    reach = archive.where(within(F.col("published_at"), window.previous_start, window.end) & F.col("decision").isin(*ASSERTING))
    if window.versions is not None:
        reach = reach.where(F.col("classifier_version").isin(*window.versions))
    if window.threat_type is not None:
        reach = reach.where(F.col("threat_type") == window.threat_type)
    base = reach.select("id", "classifier_version", "created_event", "national_scope", (F.col("published_at") >= F.lit(window.start).cast("timestamp")).alias("now"))
    names = locations.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    now, made = F.col("now"), F.col("created_event")
    rows = attributed(base, bridge, regions).where(F.col("region_id").isNotNull()).groupBy("region_id", "classifier_version").agg(count_where(now).alias("current_messages"), count_where(now & made).alias("current_events"), count_where(~now).alias("previous_messages"), count_where(~now & made).alias("previous_events")).join(names, "region_id")
    whole = Window.partitionBy("classifier_version")
    rows = rows.withColumns({f"{p}_share_raw": share(F.col(f"{p}_events"), F.sum(f"{p}_events").over(whole)) for p in ("current", "previous")})
    rows = rows.select("*", _rank("current_events", "current_rank"), _rank("previous_events", "previous_rank"))
    delta = F.col("current_share_raw") - F.col("previous_share_raw")
    trend = (
        F.when((F.col("previous_events") == 0) & (F.col("current_events") > 0), F.lit("new"))
        .when((F.col("current_events") == 0) & (F.col("previous_events") > 0), F.lit("gone"))
        .when(delta > 0.02, F.lit("rising"))
        .when(delta < -0.02, F.lit("falling"))
        .otherwise(F.lit("steady"))
    )
    return rows.select("region_id", "region_name", "classifier_version", "current_messages", "current_events", "previous_messages", "previous_events", rounded(F.col("current_share_raw")).alias("current_share"), rounded(F.col("previous_share_raw")).alias("previous_share"), "current_rank", "previous_rank", (F.col("current_events") - F.col("previous_events")).alias("delta_events"), rounded(delta).alias("delta_share"), (F.col("previous_rank") - F.col("current_rank")).alias("rank_delta"), trend.alias("trend"))


def message_versions(archive: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, versions): the distinct versions that judged each message that `wanted` names; others are not grouped."""
    named = wanted.select(F.col(key).alias("source_message_id")).distinct()
    return archive.select("source_message_id", "classifier_version").join(named, "source_message_id", "left_semi").groupBy(F.col("source_message_id").alias(key)).agg(F.collect_set("classifier_version").alias("versions"))


def one_version(versions: Column, wanted: tuple[str, ...] | None) -> Column:
    """The version if there is exactly one, or the one asked for if it is among them; else null (unattributed)."""
    only = F.when(F.size(versions) == 1, F.get(versions, F.lit(0)))
    if wanted is not None and len(wanted) == 1:
        return F.when(F.array_contains(versions, wanted[0]), F.lit(wanted[0])).otherwise(only)
    return only


def _attributed_assertions(assertions: DataFrame, archive: DataFrame, window: AnalyticsWindow, at: str, message: str) -> DataFrame:
    rows = assertions.where(within(F.col(at), window.start, window.end))
    if window.threat_type is not None:
        rows = rows.where(F.col("threat_type") == window.threat_type)
    rows = rows.join(message_versions(archive, message, rows), message, "left")
    if window.versions is not None:
        rows = rows.where(F.arrays_overlap("versions", F.array(*(F.lit(v) for v in window.versions))))
    held = seconds_between(F.col("asserted_at"), F.col("withdrawn_at"))
    return rows.select("id", "event_id", "source_id", "location_id", "threat_type", "withdrawn_at", held.alias("held"), one_version(F.col("versions"), window.versions).alias("classifier_version"))


def loss_points(assertions: DataFrame, archive: DataFrame, regions: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Withdrawals by region, source and class: counts and exact percentiles of how long the claims were held. These keep a
    group's distinct durations in memory, counted; durations are whole seconds, so there are few beside the rows."""
    lost = _attributed_assertions(assertions, archive, window, "withdrawn_at", "withdrawn_message_id").join(regions, "location_id", "left").withColumn("region", F.coalesce("region_id", "location_id"))

    one = lambda dimension, key: F.struct(F.lit(dimension).alias("dimension"), F.col(key).alias("key"))
    # one pass: a withdrawal counts in each of its three dimensions
    rows = lost.select("event_id", "source_id", "held", "classifier_version", F.explode(F.array(one("oblast", "region"), one("source", "source_id"), one("threat_type", "threat_type"))).alias("d"))
    found = rows.groupBy("d.dimension", "d.key", "classifier_version").agg(F.count("*").alias("withdrawals"), F.count_distinct("event_id").alias("events"), F.count_distinct("source_id").alias("sources"), rounded(F.percentile("held", F.lit(0.5)), 1).alias("median_held_seconds"), rounded(F.percentile("held", F.lit(0.9)), 1).alias("p90_held_seconds"))
    return found.select("dimension", "key", "classifier_version", "withdrawals", "events", F.when(F.col("dimension") == "source", F.lit(1).cast("long")).otherwise(F.col("sources")).alias("sources"), "median_held_seconds", "p90_held_seconds")


def interception(assertions: DataFrame, archive: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """By version: claims opened in the window, how many of them were taken back, and the median time held."""
    rows = _attributed_assertions(assertions, archive, window, "asserted_at", "asserted_message_id")
    counts = rows.groupBy("classifier_version").agg(F.count("*").alias("asserted"), count_where(F.col("withdrawn_at").isNotNull()).alias("withdrawn"), F.percentile("held", F.lit(0.5)).alias("median"))
    return counts.select("classifier_version", "asserted", "withdrawn", rounded(share(F.col("withdrawn"), F.col("asserted"))).alias("withdrawn_share"), rounded(F.col("median"), 1).alias("median_held_seconds"))


def interception_overall(by_version: DataFrame) -> DataFrame:
    """One row over interception(): sums, their share, and the element at half the number of the versions' medians."""
    medians = F.sort_array(F.collect_list("median_held_seconds"))
    out = by_version.agg(F.coalesce(F.sum("asserted"), F.lit(0)).alias("asserted"), F.coalesce(F.sum("withdrawn"), F.lit(0)).alias("withdrawn"), F.get(medians, F.floor(F.size(medians) / 2).cast("int")).alias("median_held_seconds"))
    return out.withColumn("withdrawn_share", rounded(share(F.col("withdrawn"), F.col("asserted"))))


def closed_events(assertions: DataFrame, archive: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Events closed by withdrawal in the window, with their last assertion and last withdrawal."""
    by_id = lambda at: F.struct(at, F.col("id"))
    last = assertions.groupBy("event_id").agg(
        F.min_by(F.struct("source_id", "location_id", "asserted_at"), by_id(-F.unix_micros("asserted_at"))).alias("a"),
        F.min_by(F.struct("source_id", "location_id", "withdrawn_at", "withdrawal_reason", "withdrawn_message_id"), F.when(F.col("withdrawn_at").isNotNull(), by_id(-F.unix_micros("withdrawn_at")))).alias("w"),
        F.bool_and(F.col("withdrawn_at").isNotNull()).alias("closed"),
    )
    rows = last.where(F.col("closed") & within(F.col("w.withdrawn_at"), window.start, window.end)).withColumn("withdrawn_message_id", F.col("w.withdrawn_message_id"))
    rows = rows.join(message_versions(archive, "withdrawn_message_id", rows), "withdrawn_message_id", "left")
    return rows.select("event_id", F.col("a.source_id").alias("last_asserted_by"), F.col("a.location_id").alias("last_asserted_for"), F.col("w.source_id").alias("withdrawn_by"), F.col("w.location_id").alias("withdrawn_for"), F.col("w.withdrawal_reason").alias("withdrawal_reason"), rounded(seconds_between(F.col("a.asserted_at"), F.col("w.withdrawn_at")), 1).alias("held_seconds"), F.date_format("w.withdrawn_at", "yyyy-MM-dd HH:mm:ss").alias("withdrawn_at"), one_version(F.col("versions"), window.versions).alias("classifier_version"))


def source_performance(archive: DataFrame, sources: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """What each source sent under each version, how often it was first, and how far behind it was otherwise."""
    base = archive.where(in_window(window))
    keys = ["classifier_version", "event_id"]
    told = base.where(F.col("event_id").isNotNull())
    firsts = told.groupBy(*keys).agg(F.min("published_at").alias("first_at"), F.min_by("source_id", F.struct("published_at", "id")).alias("leader"))
    led = firsts.groupBy("classifier_version", F.col("leader").alias("source_id")).agg(F.count("*").alias("first_reports"))
    per_event = told.groupBy(*keys, "source_id").agg(F.min("published_at").alias("own_at")).join(firsts, keys).withColumn("lag", seconds_between(F.col("first_at"), F.col("own_at")))
    lags = per_event.groupBy("classifier_version", "source_id").agg(count_where(F.col("lag") > 0).alias("follow_ups"), rounded(F.percentile(F.when(F.col("lag") > 0, F.col("lag")), F.lit(0.5)), 1).alias("median_lag_seconds"))
    kinds = {"corroborations": "event_merged", "redirects": "redirect", "de_escalations": "de_escalation", "coalesced": "coalesced", "ignored": "ignored", "unrecognized": "unrecognized"}
    counts = base.groupBy("source_id", "classifier_version").agg(
        F.count("*").alias("messages"),
        count_where(F.col("created_event")).alias("events_raised"),
        *(count_where(F.col("decision") == value).alias(name) for name, value in kinds.items()),
        count_where((F.col("decision") == "de_escalation") & (F.col("withdrawn_assertions") == 0)).alias("empty_withdrawals"),
        *(count_where(F.col("ignored_reason") == reason).alias(reason) for reason in ("no_location", "not_an_assertion")),
    )
    names = sources.select(F.col("id").alias("source_id"), "name", "tier", "independence_group")
    own = ["classifier_version", "source_id"]
    rows = counts.join(names, "source_id", "left").join(led, own, "left").join(lags, own, "left")
    of = lambda *names: rounded(sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.col("messages"))
    return rows.select(*counts.columns, F.coalesce("name", "source_id").alias("name"), F.coalesce("tier", F.lit("?")).alias("tier"), F.coalesce("independence_group", F.lit("?")).alias("independence_group"), F.coalesce("first_reports", F.lit(0)).alias("first_reports"), F.coalesce("follow_ups", F.lit(0)).alias("follow_ups"), "median_lag_seconds", of("events_raised", "corroborations", "redirects").alias("signal_share"), of("corroborations", "coalesced").alias("duplicate_share"), of("ignored", "unrecognized").alias("unreadable_share"))


def version_pairs(archive: DataFrame, a: str, b: str) -> DataFrame:
    """Messages that both versions judged: each side's decision and class."""
    side = lambda v, p: archive.where(F.col("classifier_version") == v).select("source_message_id", F.col("decision").alias(f"{p}_decision"), F.col("threat_type").alias(f"{p}_type"))
    return side(a, "a").join(side(b, "b"), "source_message_id")


def version_comparison(archive: DataFrame, a: str, b: str) -> DataFrame:
    """One row: messages judged by both, by one alone, and how many of the shared agree in decision and in class."""
    of = lambda v: archive.where(F.col("classifier_version") == v).select("source_message_id")
    shared = version_pairs(archive, a, b).agg(F.count("*").alias("shared"), count_where(F.col("a_decision") == F.col("b_decision")).alias("agreed"), count_where(~F.col("a_type").eqNullSafe(F.col("b_type"))).alias("class_changed"))
    only_a = of(a).join(of(b), "source_message_id", "left_anti").agg(F.count("*").alias("only_a"))
    only_b = of(b).join(of(a), "source_message_id", "left_anti").agg(F.count("*").alias("only_b"))
    return shared.crossJoin(only_a).crossJoin(only_b)  # three single rows


def decision_migration(archive: DataFrame, a: str, b: str) -> DataFrame:
    return version_pairs(archive, a, b).groupBy("a_decision", "b_decision").agg(F.count("*").alias("messages"))


def composition_share(archive: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Shares of the classes in the class mentions of each bucket and version."""
    bucket = local_bucket(F.col("published_at"), window.bucket, window.zone).cast("string")
    classes = mentioned_classes()
    rows = archive.where(in_window(window) & F.col("decision").isin(*ASSERTING)).select(bucket.alias("bucket"), "classifier_version", F.explode(classes).alias("threat_type"))
    counts = rows.groupBy("bucket", "classifier_version", "threat_type").agg(F.count("*").alias("messages"))
    whole = F.sum("messages").over(Window.partitionBy("bucket", "classifier_version"))
    return counts.withColumn("share", rounded(share(F.col("messages"), whole)))


def mentioned_classes() -> Column:
    """The candidate classes of a message, or its one class."""
    own = F.array(F.coalesce("threat_type", F.lit("unknown")))
    return F.when(F.size("candidate_threat_types") > 0, F.col("candidate_threat_types")).otherwise(own)


def top_indicators(archive: DataFrame, window: AnalyticsWindow, n: int) -> DataFrame:
    """The n most frequent indicators, ties by name, with the versions' messages."""
    rows = archive.where(in_window(window)).select("classifier_version", F.explode("indicators").alias("indicator"))
    counts = rows.groupBy("indicator").agg(F.count("*").alias("messages"), F.count_distinct("classifier_version").alias("versions"))
    return counts.orderBy(F.desc("messages"), "indicator").limit(n)


def archive_coverage(archive: DataFrame) -> DataFrame:
    """What the archive holds of each version, and with how many other versions its span overlaps."""
    spans = archive.groupBy("classifier_version").agg(F.count("*").alias("messages"), F.count_distinct("source_id").alias("sources"), F.count_distinct("event_id").alias("events"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    a, b = spans.alias("a"), spans.select(F.col("classifier_version").alias("v"), F.col("first_at").alias("f"), F.col("last_at").alias("l")).alias("b")
    met = a.join(b, (F.col("a.classifier_version") != F.col("v")) & (F.col("a.first_at") <= F.col("l")) & (F.col("f") <= F.col("a.last_at")), "left")
    grouped = met.groupBy("classifier_version", "messages", "sources", "events", "first_at", "last_at").agg(F.count("v").alias("overlapping"))
    return grouped.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


def version_safety(archive: DataFrame, window: AnalyticsWindow) -> DataFrame:
    """Whether a series over the window is comparable with itself: the versions in it, and messages without one."""
    rows = archive.where(in_window(window)).agg(F.array_sort(F.collect_set("classifier_version")).alias("versions"), count_where(F.col("classifier_version").isNull()).alias("unattributed"))
    return rows.select(F.array_join("versions", ",").alias("versions"), (F.size("versions") <= 1).alias("comparable"), "unattributed")


def strategic_overview(tables: dict[str, DataFrame], window: AnalyticsWindow, losses: AnalyticsWindow | None = None) -> dict[str, DataFrame]:
    """The slices that a reader of the whole archive asks for together; losses: a window of their own for loss points."""
    t = tables
    return {
        "threat_dynamics": threat_dynamics(t["archive"], t["bridge"], t["locations"], t["regions"], window),
        "geography_shift": geography_shift(t["archive"], t["bridge"], t["locations"], t["regions"], window),
        "loss_points": loss_points(t["assertions"], t["archive"], t["regions"], losses or window),
        "source_performance": source_performance(t["archive"], t["sources"], window),
        "composition_share": composition_share(t["archive"], window),
        "archive_coverage": archive_coverage(t["archive"]),
    }
