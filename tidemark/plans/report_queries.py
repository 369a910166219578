"""Report rows over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeops import text as stamped
from ..operators import reports as R, trust
from . import binding as B
from .binding import ARCHIVE_SQL as MC, ASSERTIONS_SQL as TA, SOURCES_SQL as SRC, stamp, with_sql

K = "json_extract_string(props, '$.k')::BIGINT"
CLASSES = "['uav', 'ballistic_missile', 'cruise_missile', 'guided_air_bomb', NULL, 'artillery']"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type <> 'click'")
    return e.groupBy((F.col("event_id") % 150).alias("territory_id"), F.coalesce(B.pick(B.CLASSES, F.col("k")), F.lit("unknown")).alias("threat_type"), (F.col("k") % 97 % 4).alias("level")).agg(F.max("event_id").alias("newest"))


STATES = f"st AS (SELECT event_id % 150 AS territory_id, coalesce({CLASSES}[k % 6 + 1], 'unknown') AS threat_type, k % 97 % 4 AS level, max(event_id) AS newest FROM (SELECT *, {K} AS k FROM events) WHERE event_type <> 'click' GROUP BY ALL)"


def broad_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_broad_pairs(_states(spark, sf_dir), 110).select("territory_id", "threat_type", "level")


BROAD = f"WITH {STATES} SELECT territory_id, threat_type, level FROM st QUALIFY count(*) OVER (PARTITION BY threat_type, level) <= 110"


def icon_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked_icons(_states(spark, sf_dir), [F.desc("level"), F.desc("newest"), F.asc("threat_type")]).select("territory_id", "threat_type", "level", "rank", "overflow")


ICONS = f"WITH {STATES} SELECT territory_id, threat_type, level, row_number() OVER (PARTITION BY territory_id ORDER BY level DESC, newest DESC, threat_type) AS rank, greatest(count(*) OVER (PARTITION BY territory_id) - 3, 0) AS overflow FROM st QUALIFY rank <= 3"


def downtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.archive(spark, sf_dir).withColumn("location_id", F.concat(F.lit("n"), (F.col("id").cast("long") % 25).cast("string")))
    rows = R.downtime_summary(a.withColumn("threat_type", F.coalesce("threat_type", F.lit("unknown"))), 60)
    return rows.select("location_id", "threat_type", "messages", stamped(F.col("first_at")).alias("first_at"), stamped(F.col("last_at")).alias("last_at"))


DOWNTIME = with_sql(MC) + f""", d AS (SELECT DISTINCT 'n' || (id::BIGINT % 25) AS location_id, coalesce(threat_type, 'unknown') AS threat_type, source_id, published_at FROM mc WHERE classified_at - published_at >= INTERVAL '60 minutes')
SELECT location_id, threat_type, count(*) AS messages, {stamp("min(published_at)")} AS first_at, {stamp("max(published_at)")} AS last_at FROM d GROUP BY ALL"""


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("worker"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("done")).alias("status"))
    return R.run_totals(runs, ["worker"]).select("worker", "runs", "failed", stamped(F.col("first_at")).alias("first_at"), stamped(F.col("last_at")).alias("last_at"), "last_status")


RUNS = f"""SELECT user_id % 20 AS worker, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, {stamp("min(ts)")} AS first_at, {stamp("max(ts)")} AS last_at,
  arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END, (ts, event_id)) AS last_status FROM events GROUP BY ALL"""


def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _events(spark, sf_dir).where("event_type = 'purchase'").select((F.col("user_id") % 60).alias("key"), F.col("ts").alias("at"))
    return R.admissions(spark.range(70).select(F.col("id").alias("key")), done, datetime(2024, 1, 20), True, 10**6, 8 * 3600)


ADMISSION = """WITH l AS (SELECT user_id % 60 AS key, max(ts) AS t FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20' GROUP BY ALL), w AS (SELECT k AS key, ceil(28800 - (epoch(TIMESTAMP '2024-01-20') - epoch(t))) AS w FROM range(70) x(k) LEFT JOIN l ON l.key = k)
SELECT key, CASE WHEN w > 0 THEN 'cooldown' ELSE 'admitted' END AS verdict, CASE WHEN w > 0 THEN w::BIGINT END AS wait_seconds FROM w"""


def outcome_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.assertions(spark, sf_dir)
    first = trust.latest(a, ["event_id"], [-F.unix_micros("asserted_at"), F.col("id")]).select("event_id", "location_id", "independence_group", F.col("asserted_at").alias("published_at"))
    alerts = B.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("location_id"), F.timestamp_micros(F.unix_micros("o_orderdate") + 12 * 3_600_000_000).alias("started_at"))
    return R.outcomes(first, alerts, a, 5 * 3600)


OUTCOMES = with_sql(TA) + """, f AS (SELECT event_id, location_id, independence_group AS g, asserted_at AS t FROM ta QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY asserted_at, id DESC) = 1),
o AS (SELECT f.*, (SELECT min(o_orderdate + INTERVAL '12 hours') FROM orders WHERE o_orderstatus = 'F' AND 'c' || o_custkey = f.location_id AND o_orderdate + INTERVAL '12 hours' BETWEEN f.t AND f.t + INTERVAL '5 hours') AS a,
  (SELECT min(asserted_at) FROM ta WHERE ta.event_id = f.event_id AND ta.independence_group <> f.g AND asserted_at BETWEEN f.t AND f.t + INTERVAL '5 hours') AS b FROM f)
SELECT event_id, CASE WHEN a IS NOT NULL THEN 'confirmed_official' WHEN b IS NOT NULL THEN 'confirmed_independent' ELSE 'unconfirmed' END AS outcome, trunc(epoch(coalesce(a, b)) - epoch(t))::BIGINT AS confirmed_seconds FROM o"""


def trust_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their latest measured trust, its label and what it does to a contribution."""
    history = _events(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("id"), (F.col("k") % 21 / 20).alias("trust"), F.col("ts").alias("at"), "event_id").where("trust IS NOT NULL")
    last = trust.latest(history, ["id"], [F.col("at"), F.col("event_id")]).select("id", "trust")
    rows = B.sources(spark, sf_dir).join(last, "id", "left")
    return rows.select("id", "tier", "trust", trust.trust_label(F.col("trust")).alias("label"), trust.trust_modifier(F.col("trust")).alias("modifier"))


LISTING = with_sql(SRC) + f""", h AS (SELECT 's' || (user_id % 10) AS id, {K} % 21 / 20 AS trust FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) = 1)
SELECT s.id, tier, trust, CASE WHEN trust >= 0.65 THEN 'high' WHEN trust <= 0.4 THEN 'reduced' WHEN trust IS NOT NULL THEN 'usual' END AS label,
  CASE WHEN trust IS NULL THEN 1.0 WHEN trust <= 0.5 THEN floor((0.6 + 0.4 * (trust / 0.5)) * 10000 + 0.5) / 10000 ELSE floor((1 + 0.2 * ((trust - 0.5) / 0.5)) * 10000 + 0.5) / 10000 END AS modifier FROM src s LEFT JOIN h USING (id)"""

QUERIES = {
    "broad_pairs": (broad_pairs, BROAD),
    "icon_ranking": (icon_ranking, ICONS),
    "downtime_summary": (downtime_summary, DOWNTIME),
    "run_totals": (run_totals, RUNS),
    "request_admission": (request_admission, ADMISSION),
    "outcome_evaluation": (outcome_evaluation, OUTCOMES),
    "trust_listing": (trust_listing, LISTING),
}
