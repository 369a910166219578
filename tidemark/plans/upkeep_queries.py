"""Texts within a budget, replays of verdicts and the feed of a region array over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timing import estimated_tokens
from ..operators import upkeep as U
from ..sources import feeds
from . import binding as B

BUDGET = 400


def budgeted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns of each role of conversations, dealt to 60 places, within a budget; a turn is a minute."""
    c = B.load(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60)
    lines = c.select((F.col("conv_id") % 60).cast("string").alias("location_id"), F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("id"), at.alias("at"), (estimated_tokens(F.col("text")) + 1).alias("tokens"), "text")
    out = U.budgeted_texts(lines, BUDGET)
    return out.withColumn("content", F.sha2("content", 256))


TEXTS = rf"""WITH lines AS (SELECT (conv_id % 60)::VARCHAR AS location_id, conv_id, turn, text, ceil(c / 2.8 + l / 4 + (n - c - l) / 1.5)::BIGINT + 1 AS tokens FROM (
  SELECT *, length(text) AS n, length(regexp_replace(text, '[^\x{{400}}-\x{{52F}}]', '', 'g')) AS c, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))::DOUBLE AS l FROM conversations WHERE text IS NOT NULL)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY location_id ORDER BY conv_id * 3600 + turn * 60 DESC, lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 5, '0') DESC ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS kept FROM lines)
SELECT location_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY conv_id * 3600 + turn * 60, lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 5, '0')) FILTER (WHERE kept), '')) AS content,
  coalesce(sum(tokens) FILTER (WHERE kept), 0)::BIGINT AS tokens, count(*) FILTER (WHERE kept) AS entries, count(*) FILTER (WHERE NOT kept) AS compact_entries, coalesce(sum(tokens) FILTER (WHERE NOT kept), 0)::BIGINT AS compact_tokens
FROM summed GROUP BY location_id"""


def _verdicts(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    a = B.archive(spark, sf_dir).where(F.col("classifier_version") == version)
    places = B.bridge(spark, sf_dir).where("role = 'asserted'").groupBy("classification_id").agg(F.collect_set("location_id").alias("places"))
    rows = a.join(places, a["id"] == places["classification_id"], "left")
    return rows.select(F.col("source_message_id").alias("message_id"), "threat_type", "places", F.col("decision").isin("event_created", "event_merged", "redirect").alias("significant"), F.col("ignored_reason").alias("rejection"))


def replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the archive's first version against its second."""
    out = U.replay_report(U.verdict_diffs(_verdicts(spark, sf_dir, "v1"), _verdicts(spark, sf_dir, "v2")))
    return out.withColumn("examples", F.array_join("examples", ","))


REPLAY = f"""WITH {B.ARCHIVE_SQL}, {B.BRIDGE_SQL}, verdicts AS (
  SELECT source_message_id AS m, classifier_version AS v, coalesce(threat_type, 'unknown') AS kind, coalesce(places, '') AS places, decision IN ('event_created', 'event_merged', 'redirect') AS significant, ignored_reason AS reason
  FROM mc LEFT JOIN (SELECT classification_id, string_agg(DISTINCT location_id, ',' ORDER BY location_id) AS places FROM br WHERE role = 'asserted' GROUP BY 1) p ON p.classification_id = mc.id
), pairs AS (SELECT a.m, a.kind AS k1, b.kind AS k2, a.places AS p1, b.places AS p2, a.significant AS s1, b.significant AS s2, b.reason FROM verdicts a JOIN verdicts b ON a.m = b.m AND a.v = 'v1' AND b.v = 'v2'),
axes AS (SELECT 'threat_type' AS key, m FROM pairs WHERE k1 <> k2 UNION ALL SELECT 'locations', m FROM pairs WHERE p1 <> p2 UNION ALL SELECT 'significance', m FROM pairs WHERE s1 <> s2)
SELECT 'axis' AS part, key, count(*) AS messages, array_to_string(list_sort(list(m))[1:20], ',') AS examples FROM axes GROUP BY key
UNION ALL SELECT 'move', k1 || ' -> ' || k2, count(*), '' FROM pairs WHERE k1 <> k2 GROUP BY ALL
UNION ALL SELECT 'significance', CASE WHEN s2 THEN 'significant' ELSE 'ignored: ' || coalesce(reason, 'unknown') END AS key, count(*), '' FROM pairs WHERE s1 <> s2 GROUP BY ALL"""


def feed_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body for each event, of three regions with alerts of some types and stamps, read, put into the general shape and
    read again."""
    e = B.dealt(B.load(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    n, stamp = F.col("event_id"), lambda s: F.date_format(F.timestamp_micros(F.unix_micros("ts") + s * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    alert = lambda kind, at: F.concat(F.lit('{"type": "'), kind, F.lit('"'), F.when(at.isNotNull(), F.concat(F.lit(', "lastUpdate": "'), at, F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    region = lambda name, level, *alerts: F.concat(F.lit('{"regionName": "'), name, F.lit('", "regionType": "' + level + '", "activeAlerts": ['), F.concat_ws(", ", *alerts), F.lit("]}"))
    none = F.lit(None).cast("string")
    body = F.concat(
        F.lit('{"id": '), n.cast("string"), F.lit(', "raw": ['),
        F.concat_ws(", ", region(F.lit(" A  one "), "District", alert(F.lit("air"), stamp(F.lit(-60))), alert(F.lit("AIR"), stamp(F.lit(-90)))), region(F.lit("B"), "Community", alert(F.when(n % 2 == 0, "AIR_RAID").otherwise("ARTILLERY"), none)), region(F.lit("a ONE"), "State", alert(F.lit("AIR"), stamp(-(n % 200)))), F.lit("7"), region(F.lit(""), "State", alert(F.lit("AIR"), none))),
        F.lit("]}"),
    )
    regions = feeds.region_array(e.select(body.alias("body"), F.col("ts").alias("cached_at")))
    again = feeds.alert_snapshot(feeds.snapshot_body(regions))
    return again.groupBy("location_name", "alert_type", "active").agg(F.count("*").alias("regions"), F.min("started_at").cast("string").alias("first_at"), F.max("started_at").cast("string").alias("last_at"))


FEED_ARRAY = """WITH x AS (SELECT 'A one' AS name, ts - to_seconds(greatest(90, event_id % 200)) AS began FROM events UNION ALL SELECT 'B', ts FROM events WHERE event_id % 2 = 0)
SELECT name AS location_name, 'air' AS alert_type, true AS active, count(*) AS regions, strftime(min(date_trunc('second', began)), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(date_trunc('second', began)), '%Y-%m-%d %H:%M:%S') AS last_at FROM x GROUP BY name"""

QUERIES = {"budgeted_texts": (budgeted_texts, TEXTS), "replay_report": (replay_report, REPLAY), "feed_array": (feed_array, FEED_ARRAY)}
