"""States, delivery, evaluation, movement and text tagging over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import texts as X
from ..functions.numbers import risk_level, rounded
from ..functions.timeops import text as stamped
from ..operators import delivery as Q, evaluation as E, hierarchy as H, movement as M, states as S
from . import binding as B
from .binding import ARCHIVE_SQL as MC, ASSERTIONS_SQL as TA, LOCATIONS_SQL as LOC, TREE_SQL as TREE, r, stamp, with_sql

AS_OF, CLAIMS_AS_OF = datetime(2024, 1, 30), datetime(1998, 1, 1)
NOW = f"TIMESTAMP '{AS_OF}'"
K = "json_extract_string(props, '$.k')::BIGINT"
EV = f"ev AS (SELECT *, {K} AS k FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _later(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes.cast("long") * 60_000_000)


def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select("event_id", F.col("ts").alias("published_at"), F.when(F.col("k") % 3 != 0, F.lit("ended")).otherwise(F.lit("active")).alias("status"), F.when(F.col("k") % 3 != 0, _later(F.col("ts"), F.col("k") * 60)).alias("ended_at"))
    return S.as_of(rows, datetime(2024, 1, 20)).select("event_id", "status", stamped(F.col("ended_at")).alias("ended_at"))


ASOF = f"""WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 OR e > c THEN 'active' ELSE 'ended' END AS status, CASE WHEN e <= c THEN {stamp("e")} END AS ended_at
FROM (SELECT event_id, k, ts, CASE WHEN k % 3 <> 0 THEN ts + to_hours(k) END AS e, TIMESTAMP '2024-01-20' AS c FROM ev) WHERE ts <= c"""


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    return S.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


LATEST = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def content_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.load(spark, sf_dir, "conversations")
    rows = c.select(F.col("role").alias("source_id"), (F.col("conv_id") % 50).cast("string").alias("external_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("received_at"))
    return S.revisions(rows)


REVISIONS = """SELECT source_id, external_id, content_hash, first_seen, row_number() OVER (PARTITION BY source_id, external_id ORDER BY first_seen, content_hash) AS revision
FROM (SELECT role AS source_id, (conv_id % 50)::VARCHAR AS external_id, sha256(text) AS content_hash, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY ALL)"""


def assertion_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.assertions(spark, sf_dir)
    key = ["source_id", "location_id", "threat_type"]
    rows = S.lifecycle_of(a.withColumn("claimed", F.lit(True)), key, 30 * 86_400, B.tasks(B.load(spark, sf_dir, "lineitem")))
    return rows.select(*key, *(stamped(F.col(c)).alias(c) for c in ("asserted_at", "withdrawn_at", "valid_until")))


LIFECYCLE = with_sql(TA) + f""", a AS (SELECT source_id, location_id, threat_type, max(asserted_at) AS t FROM ta GROUP BY ALL)
SELECT source_id, location_id, threat_type, {stamp("t")} AS asserted_at, {stamp("t + INTERVAL '30 days'")} AS valid_until,
  (SELECT {stamp("min(w.withdrawn_at)")} FROM ta w WHERE w.source_id = a.source_id AND w.location_id = a.location_id AND w.threat_type = a.threat_type AND w.withdrawn_at >= a.t) AS withdrawn_at FROM a"""


def event_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.assertions(spark, sf_dir).withColumn("valid_until", F.timestamp_micros(F.unix_micros("asserted_at") + 90 * 86_400_000_000))
    return S.support(a, CLAIMS_AS_OF).select("event_id", "held", stamped(F.col("supported_until")).alias("supported_until"), "claims")


SUPPORT = with_sql(TA) + f"""SELECT event_id, bool_or(h) AS held, {stamp("max(v) FILTER (WHERE h)")} AS supported_until, count(*) AS claims
FROM (SELECT event_id, asserted_at + INTERVAL '90 days' AS v, withdrawn_at IS NULL AND asserted_at + INTERVAL '90 days' > TIMESTAMP '{CLAIMS_AS_OF}' AS h FROM ta) GROUP BY event_id"""


def alert_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select(_id("s", F.col("user_id") % 10).alias("source_id"), _id("n", F.col("event_id") % 25).alias("location_id"), _id("t", F.col("k") % 3).alias("alert_type"), F.col("ts").alias("at"), "event_id", F.col("event_type").isin("purchase", "signup").alias("active"), F.when(F.col("event_type") == "view", F.col("ts")).alias("missing_since"), _later(F.col("ts"), -F.col("k")).alias("provider_started_at"))
    states = S.latest(rows, ["source_id", "location_id", "alert_type"], [F.col("at"), F.col("event_id")])
    n = F.col("id")
    sources = spark.range(10).select(_id("s", n).alias("id"), (n % 3 == 0).alias("is_api"), (n % 4 != 1).alias("enabled"), F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - n * 40_000_000).alias("last_success_at"))
    # places with an odd type see no interface
    states = states.where((F.col("alert_type") != "t1") | ~F.col("source_id").isin("s0", "s3", "s6", "s9"))
    return S.reconcile_alerts(states, sources, AS_OF, 5 * 86_400, 200).select("location_id", "alert_type", "active", stamped(F.col("started_at")).alias("started_at"), "ignored_precedence", "ignored_stale")


RECONCILE = f"""WITH {EV}, st AS (
  SELECT user_id % 10 AS s, 'n' || (event_id % 25) AS location_id, 't' || (k % 3) AS alert_type, event_type IN ('purchase', 'signup') AS active, CASE WHEN event_type = 'view' THEN ts END AS missing_since, ts - to_minutes(k) AS p
  FROM ev QUALIFY row_number() OVER (PARTITION BY s, location_id, alert_type ORDER BY ts DESC, event_id DESC) = 1
), a AS (
  SELECT *, active OR coalesce(missing_since > {NOW} - INTERVAL '5 days', false) AS would_hold, s * 40 < 200 AS alive, s % 3 = 0 AS counts FROM st WHERE alert_type <> 't1' OR s % 3 <> 0
), h AS (
  SELECT *, CASE WHEN bool_or(alive) FILTER (counts) OVER (PARTITION BY location_id, alert_type) THEN would_hold AND alive ELSE would_hold END AS holds FROM a
) SELECT location_id, alert_type, bool_or(counts AND holds) AS active, {stamp("min(p) FILTER (counts AND holds)")} AS started_at, count(*) FILTER (NOT counts AND would_hold) AS ignored_precedence, count(*) FILTER (counts AND would_hold AND NOT holds) AS ignored_stale FROM h GROUP BY ALL"""


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("threat_update", "assessment_update", "alert_start", "nightly_digest", "channel_publication", "attack_debrief", "other")
    k = F.col("k")
    payload = F.format_string('{"updateKind":"%s","evidenceLevel":"%s","timing":"%s","state":{"kind":"c","key":"k%d"}}', B.pick(("soft", "escalation", "initial"), k), B.pick(("official", "confirmed"), F.col("user_id")), B.pick(("now", "now", "now", "evening"), F.col("event_id")), k % 5)
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("chat_id"), B.pick(kinds, F.col("event_id")).alias("notification_type"), payload.alias("payload"), B.pick(("pending", "retry", "sent"), F.col("event_id") + k).alias("status"), F.col("ts").alias("created_at"), (k % 17 / 2).alias("score"))


OUTBOX = f"""ob AS (
  SELECT event_id AS id, user_id % 50 AS chat_id, ['threat_update', 'assessment_update', 'alert_start', 'nightly_digest', 'channel_publication', 'attack_debrief', 'other'][event_id % 7 + 1] AS notification_type,
    ['soft', 'escalation', 'initial'][k % 3 + 1] AS update_kind, ['official', 'confirmed'][user_id % 2 + 1] AS evidence, ['now', 'now', 'now', 'evening'][event_id % 4 + 1] AS timing, k % 5 AS state_key,
    ['pending', 'retry', 'sent'][(event_id + k) % 3 + 1] AS status, ts AS created_at, k % 17 / 2 AS score FROM (SELECT *, {K} AS k FROM events)
)"""


def json_path_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbox(spark, sf_dir).groupBy(Q.delivery_class(F.col("notification_type"), F.col("payload")).alias("delivery_class"), "notification_type").agg(F.count("*").alias("rows"))


JSON_CLASS = f"""WITH {OUTBOX} SELECT CASE notification_type WHEN 'channel_publication' THEN 'channel' WHEN 'attack_debrief' THEN 'analytics' WHEN 'alert_start' THEN 'protected' WHEN 'assessment_update' THEN 'analytics'
  WHEN 'nightly_digest' THEN 'analytics' WHEN 'other' THEN 'standard' ELSE CASE WHEN timing <> 'now' THEN 'soft' WHEN evidence = 'official' OR update_kind = 'escalation' THEN 'protected' WHEN update_kind = 'soft' THEN 'soft' ELSE 'standard' END END AS delivery_class,
  notification_type, count(*) AS rows FROM ob GROUP BY ALL"""


def queue_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coalesce_queue(_outbox(spark, sf_dir))


COALESCE = f"""WITH {OUTBOX}, ranked AS (SELECT id, first_value(id) OVER (PARTITION BY chat_id, notification_type, state_key ORDER BY created_at DESC, id DESC) AS keeper FROM ob
  WHERE status <> 'sent' AND (notification_type = 'assessment_update' OR notification_type = 'threat_update' AND update_kind = 'soft')) SELECT id, keeper FROM ranked WHERE id <> keeper"""


def topn_per_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.top_per_recipient(_outbox(spark, sf_dir).select("chat_id", "id", "score"), "chat_id", [F.desc("score"), F.asc("id")], 12)


TOPN = f"""WITH {OUTBOX} SELECT chat_id, id, score, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY chat_id) - 12, 0) AS omitted FROM ob
WINDOW w AS (PARTITION BY chat_id ORDER BY score DESC, id) QUALIFY rank <= 12"""


def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th version is missing; a gap counts in the last days before the instant only."""
    log = _events(spark, sf_dir).where(F.col("event_id") % 97 != 0).select(F.col("event_id").alias("version"), F.col("ts").alias("created_at"))
    return Q.deliverable_run(log, 100, AS_OF, 15 * 86_400).select("version")


PREFIX = f"""WITH b AS (SELECT event_id AS version, ts FROM events WHERE event_id % 97 <> 0 AND event_id > 100 ORDER BY 1 LIMIT 200),
g AS (SELECT version, version <> coalesce(lag(version) OVER (ORDER BY version), 100) + 1 AND {NOW} - ts < INTERVAL '15 days' AS gap FROM b)
SELECT version FROM g WHERE version < coalesce((SELECT min(version) FROM g WHERE gap), 1e18)"""


def subscription_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir)
    e = _events(spark, sf_dir)
    events = e.select("event_id", F.coalesce(B.pick(B.CLASSES, F.col("k")), F.lit("unknown")).alias("threat_type"), B.pick(Q.EVIDENCE_LEVELS, F.col("k")).alias("evidence_level"))
    at = e.select("event_id", _id("c", F.col("event_id") % 150).alias("location_id"))
    n = F.col("id")
    subs = spark.range(40).select(n.alias("chat_id"), F.when(n % 2 == 0, _id("n", n % 25)).otherwise(_id("c", n)).alias("location_id"), F.when(n % 3 == 0, F.lit("uav")).alias("threat_type"), B.pick(("unverified", "confirmed"), n).alias("least_evidence"))
    return Q.match_subscriptions(events, at, subs, H.closure(places))


SUBSCRIBED = with_sql(LOC, TREE) + f""", e AS (SELECT event_id, coalesce(['uav', 'ballistic_missile', 'cruise_missile', 'guided_air_bomb', NULL, 'artillery'][k % 6 + 1], 'unknown') AS t, k % 4 AS lv, 'c' || (event_id % 150) AS location_id FROM (SELECT *, {K} AS k FROM events)),
s AS (SELECT i AS chat_id, CASE WHEN i % 2 = 0 THEN 'n' || (i % 25) ELSE 'c' || i END AS location_id, CASE WHEN i % 3 = 0 THEN 'uav' END AS t, CASE WHEN i % 2 = 0 THEN 0 ELSE 2 END AS least FROM range(40) x(i)),
near AS (SELECT chat_id, t, least, descendant_id AS l FROM s JOIN tree ON ancestor_id = location_id UNION SELECT chat_id, t, least, ancestor_id FROM s JOIN tree ON descendant_id = location_id)
SELECT event_id, chat_id, count(DISTINCT e.location_id) AS locations FROM e JOIN near n ON n.l = e.location_id WHERE (n.t IS NULL OR n.t = e.t) AND lv >= least GROUP BY ALL"""


def coalesce_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("source"), (F.col("k") % 6).alias("kind"), "event_id", "ts")
    return Q.kept_after_coalescing(rows, ["source", "kind"], "ts", 12 * 3600, "event_id").select("event_id", "kept")


WINDOWED = f"""WITH RECURSIVE seq AS (SELECT user_id % 10 AS s, {K} % 6 AS c, event_id, ts, row_number() OVER (PARTITION BY user_id % 10, {K} % 6 ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT s, c, event_id, n, ts AS last_kept, true AS kept FROM seq WHERE n = 1
  UNION ALL SELECT q.s, q.c, q.event_id, q.n, CASE WHEN q.ts - w.last_kept >= INTERVAL '12 hours' THEN q.ts ELSE w.last_kept END, q.ts - w.last_kept >= INTERVAL '12 hours' FROM walk w JOIN seq q ON q.s = w.s AND q.c = w.c AND q.n = w.n + 1)
SELECT event_id, kept FROM walk"""


def assessment_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("k") * 7 % 101 / 10
    rows = _events(spark, sf_dir).select((F.col("event_id") % 25).alias("place"), "event_id", F.col("ts").alias("at"), score.alias("score"), risk_level(score).alias("level"))
    return Q.assessment_decisions(rows, "place", "event_id", cooldown_minutes=24 * 60).select("event_id", "action")


HYSTERESIS = f"""WITH RECURSIVE sc AS (SELECT event_id % 25 AS p, event_id, ts, {K} * 7 % 101 / 10 AS score FROM events),
seq AS (SELECT *, CASE WHEN score >= 8 THEN 4 WHEN score >= 6 THEN 3 WHEN score >= 4 THEN 2 WHEN score >= 2 THEN 1 ELSE 0 END AS lv, row_number() OVER (PARTITION BY p ORDER BY ts, event_id) AS n FROM sc),
walk AS (SELECT p, event_id, n, lv AS l0, score AS s0, ts AS t0, 'initial' AS action FROM seq WHERE n = 1
  UNION ALL SELECT p, event_id, n, CASE WHEN a = 'skip' THEN l0 ELSE lv END, CASE WHEN a = 'skip' THEN s0 ELSE score END, CASE WHEN a = 'skip' THEN t0 ELSE ts END, a FROM (
    SELECT q.*, w.l0, w.s0, w.t0, CASE WHEN q.lv > w.l0 THEN 'escalation' WHEN q.ts - w.t0 < INTERVAL '24 hours' THEN 'skip' WHEN q.lv < w.l0 THEN 'deescalation' WHEN abs(q.score - w.s0) < 1 THEN 'skip' ELSE 'drift' END AS a
    FROM walk w JOIN seq q ON q.p = w.p AND q.n = w.n + 1))
SELECT event_id, action FROM walk"""


def precision_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _events(spark, sf_dir).select((k % 101 / 100).alias("confidence"), F.col("ts").alias("published_at"), F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in (("purchase", "confirmed_official"), ("signup", "confirmed_independent"), ("click", "unconfirmed"))), F.lit("pending")).alias("outcome"), (F.col("user_id") % 3 == 0).alias("alert_active"), F.when(F.col("event_type").isin("purchase", "signup"), _later(F.col("ts"), k)).alias("confirmed_at"))
    return E.precision_by_threshold(rows, (0.5, 0.75, 0.85, 0.9, 0.95, 2.0))


PRECISION = f"""WITH o AS (SELECT {K} % 101 / 100 AS confidence, event_type AS t, user_id % 3 = 0 AS act, {K} * 60 AS lead FROM events), c AS (
  SELECT threshold, count(confidence) AS promotions, count(*) FILTER (t = 'purchase') AS official, count(*) FILTER (t = 'signup') AS independent, count(*) FILTER (t = 'click') AS unconfirmed, count(*) FILTER (t = 'click' AND act) AS undecidable,
    quantile_cont(CASE WHEN t IN ('purchase', 'signup') THEN lead END::DOUBLE, 0.5) AS median_lead_seconds
  FROM (VALUES (0.5::DOUBLE), (0.75), (0.85), (0.9), (0.95), (2.0)) x(threshold) LEFT JOIN o ON confidence >= threshold GROUP BY threshold)
SELECT *, CASE WHEN promotions > undecidable THEN {r("(official + independent) / (promotions - undecidable)")} END AS precision FROM c"""


def first_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_corroboration(B.assertions(spark, sf_dir))


CORROBORATION = with_sql(TA) + """, g AS (SELECT event_id, independence_group AS g, min(asserted_at) AS t FROM ta GROUP BY ALL), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY t, g) = 1)
SELECT f.event_id, f.g AS first_group, g.g AS corroborating_group, (epoch(g.t) - epoch(f.t))::BIGINT AS seconds FROM f JOIN g ON g.event_id = f.event_id AND g.g <> f.g AND g.t > f.t
QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY g.t, g.g) = 1"""


def active_at_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _id("c", F.col("o_custkey")).alias("location_id"), F.col("o_orderdate").alias("at"))
    periods = B.assertions(spark, sf_dir).where(F.col("withdrawn_at").isNotNull()).select("location_id", F.col("asserted_at").alias("started_at"), F.col("withdrawn_at").alias("ended_at"))
    return E.active_at(orders, periods)


ACTIVE = with_sql(TA) + "SELECT o_orderkey AS id, count(t.id) AS active FROM orders LEFT JOIN ta t ON t.location_id = 'c' || o_custkey AND t.withdrawn_at IS NOT NULL AND t.asserted_at <= o_orderdate AND o_orderdate < t.withdrawn_at GROUP BY o_orderkey"


def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.archive(spark, sf_dir)
    side = lambda v, p: a.where(F.col("classifier_version") == v).select("source_message_id", *(F.col(c).alias(f"{p}_{c}") for c in ("decision", "threat_type", "source_id")))
    return E.disagreement(side("v1", "a").join(side("v2", "b"), "source_message_id"), ["decision", "threat_type", "source_id"])


AGREEMENT = with_sql(MC) + f""", p AS (SELECT a.decision IS DISTINCT FROM b.decision AS d, a.threat_type IS DISTINCT FROM b.threat_type AS t, a.source_id IS DISTINCT FROM b.source_id AS s
  FROM mc a JOIN mc b USING (source_message_id) WHERE a.classifier_version = 'v1' AND b.classifier_version = 'v2'),
u AS (SELECT 'decision' AS field, d AS x FROM p UNION ALL SELECT 'threat_type', t FROM p UNION ALL SELECT 'source_id', s FROM p UNION ALL SELECT 'any', d OR t OR s FROM p)
SELECT field, count(*) FILTER (x) AS differing, count(*) AS compared, {r("count(*) FILTER (NOT x) / count(*) * 100", 1)} AS agreement_percent FROM u GROUP BY field"""


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.archive(spark, sf_dir).withColumn("region_id", _id("n", F.col("id").cast("long") % 20))
    regions = B.locations(spark, sf_dir).where("type = 'oblast'")
    return E.coverage_matrix(a, regions, datetime(2024, 1, 20, 12), 3)


COVERAGE = with_sql(MC, LOC) + """, m AS (SELECT *, 'n' || (id::BIGINT % 20) AS region_id FROM mc WHERE published_at > TIMESTAMP '2024-01-19 12:00' AND published_at <= TIMESTAMP '2024-01-20 12:00')
SELECT l.id AS region_id, l.name, count(DISTINCT source_id) AS sources, count(m.id) AS messages_day, count(m.id) FILTER (published_at > TIMESTAMP '2024-01-20 09:00') AS messages_recent, count(m.id) FILTER (created_event) AS events_raised
FROM loc l LEFT JOIN m ON m.region_id = l.id WHERE l.type = 'oblast' GROUP BY ALL"""


def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prior_context(B.archive(spark, sf_dir), 6 * 3600, 5)


PRIOR = with_sql(MC) + "SELECT id, least(count(*) OVER (PARTITION BY source_id ORDER BY floor(epoch(published_at))::BIGINT RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING), 5) AS prior FROM mc"


def poisson_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.load(spark, sf_dir, "orders").select(_id("c", F.col("o_custkey") % 40).alias("key"), (F.col("o_orderkey") % 9).cast("double").alias("days"))
    return E.poisson_estimate(rows, 30)


POISSON = f"""WITH m AS (SELECT 'c' || (o_custkey % 40) AS key, avg((o_orderkey % 9)::DOUBLE) AS mean, count(*) AS gaps FROM orders GROUP BY ALL HAVING mean > 0), x AS (SELECT *, 1.0 / mean AS l, 1.0 / mean * 30 AS e FROM m)
SELECT key, gaps, {r("mean", 3)} AS mean_days, {r("l")} AS rate, {r("1 - exp(-l)")} AS p_daily, {r("e", 2)} AS expected, {r("greatest(e - sqrt(e), 0)", 2)} AS low, {r("e + sqrt(e)", 2)} AS high,
  CASE WHEN {r("1 - exp(-l)")} >= 0.6 THEN 'high' WHEN {r("1 - exp(-l)")} >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM x"""


def sector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    places = B.load(spark, sf_dir, "customer").select(_id("c", n).alias("id"), (44 + n * 13 % 800 / 100).alias("lat"), (22 + n * 7 % 1800 / 100).alias("lon"))
    return M.in_sector(places, 48.5, 31.0, 60.0, 45.0, 700.0, 20).select("id", rounded(F.col("km"), 3).alias("km"), rounded(F.col("off"), 3).alias("off_degrees"))


SECTOR = f"""WITH p AS (SELECT 'c' || c_custkey AS id, 44 + c_custkey * 13 % 800 / 100 AS lat, 22 + c_custkey * 7 % 1800 / 100 AS lon FROM customer), q AS (
  SELECT id, 2 * {M.EARTH_KM} * asin(least(1, sqrt(pow(sin(radians(lat - 48.5) / 2), 2) + cos(radians(48.5)) * cos(radians(lat)) * pow(sin(radians(lon - 31.0) / 2), 2)))) AS km,
    degrees(atan2(sin(radians(lon - 31.0)) * cos(radians(lat)), cos(radians(48.5)) * sin(radians(lat)) - sin(radians(48.5)) * cos(radians(lat)) * cos(radians(lon - 31.0)))) - 60 AS d FROM p),
s AS (SELECT id, km, CASE WHEN d < -180 THEN d + 360 WHEN d >= 180 THEN d - 360 ELSE d END AS off FROM q)
SELECT id, {r("km", 3)} AS km, {r("off", 3)} AS off_degrees FROM s WHERE km > 0 AND km <= 700 AND abs(off) <= 45 ORDER BY s.km, id LIMIT 20"""


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    steps = e.select((F.col("k") * 40 + F.col("user_id") % 40).alias("event_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), _id("n", F.col("value").cast("long") % 3).alias("location_id"), (F.col("user_id") % 4).alias("independence_group"))
    return M.segments(steps)


SEGMENTS = f"""WITH s AS (SELECT {K} * 40 + user_id % 40 AS event_id, event_id AS id, ts, 'n' || (trunc(value)::BIGINT % 3) AS p, user_id % 4 AS g FROM events),
l AS (SELECT *, lag(p) OVER w AS f, lag(ts) OVER w AS ft, lag(g) OVER w AS fg FROM s WINDOW w AS (PARTITION BY event_id ORDER BY ts, id))
SELECT event_id, id, f AS from_id, p AS to_id, greatest(trunc(epoch(ts) - epoch(ft))::BIGINT, 0) AS seconds, fg <> g AS independent FROM l WHERE f <> p"""

#: Messages, with the classes, outcomes and counts that they name, by hand.
MESSAGES = [
    ("Загроза балістики для області", "ballistic_missile", "", ""),
    ("10 шахедів курсом на місто, ще БпЛА: 4", "uav", "", "uav=10"),
    ("Кабмін ухвалив постанову", "", "", ""),
    ("КАБи на прикордоння, 2 КАБи", "guided_air_bomb", "", "guided_air_bomb=2"),
    ("Крилаті ракети, Калібр з моря; 6 ракет", "cruise_missile", "", "cruise_missile=6"),
    ("Вибухи в місті, працює ППО", "", "explosion,air_defence", ""),
    ("Реактивна артилерія та РСЗВ", "mlrs", "", ""),
    ("Пара реактивних з півночі", "uav", "", ""),
    ("Артилерійський обстріл, мінометний обстріл", "artillery,mortar", "", ""),
    ("Збито 7 цілей, уламки впали", "", "downed,debris", "unknown=7"),
    ("Активність авіації, цілей — 3, 999 ракет", "aviation", "", "unknown=3"),
    ("все спокійно", "", "", ""),
]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", B.pick(tuple(m[0] for m in MESSAGES), F.col("event_id")).alias("text"))


def _expected(column: int) -> str:
    return "[" + ", ".join("'{}'".format(m[column]) for m in MESSAGES) + f"][event_id % {len(MESSAGES)} + 1]"


def regex_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("event_id", F.array_join(X.threat_classes(F.col("text")), ",").alias("classes"), F.array_join(X.raid_outcomes(F.col("text")), ",").alias("outcomes"))


REGEX_TAGS = f"SELECT event_id, {_expected(1)} AS classes, {_expected(2)} AS outcomes FROM events"


def reported_counts_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.transform(X.reported_counts(F.col("text")), lambda x: F.concat_ws("=", x["threat_type"], x["count"].cast("string")))
    return _messages(spark, sf_dir).select("event_id", F.array_join(counts, ",").alias("counts"))


REPORTED = f"SELECT event_id, {_expected(3)} AS counts FROM events"


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id").orderBy(F.desc("user_id"), F.asc("event_id")).offset(40).limit(20)


PAGE = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY user_id DESC, event_id LIMIT 20 OFFSET 40"


def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of three kinds about one place, each kind cut before the union so that little is sorted."""
    e = _events(spark, sf_dir).where(F.col("event_id") % 25 == 3)
    kind = lambda name, condition: e.where(condition).select(F.lit(name).alias("kind"), "event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(30)
    rows = kind("threat", "event_type = 'purchase'").unionByName(kind("alert", "event_type = 'signup'")).unionByName(kind("assessment", "event_type = 'view'"))
    return rows.orderBy(F.desc("ts"), "kind", "event_id").limit(30).select("kind", "event_id")


TIMELINE_UNION = """SELECT kind, event_id FROM (SELECT CASE event_type WHEN 'purchase' THEN 'threat' WHEN 'signup' THEN 'alert' ELSE 'assessment' END AS kind, event_id, ts FROM events WHERE event_id % 25 = 3 AND event_type IN ('purchase', 'signup', 'view')) ORDER BY ts DESC, kind, event_id LIMIT 30"""

QUERIES = {
    "asof_status": (asof_status, ASOF),
    "latest_per_key": (latest_per_key, LATEST),
    "content_dedup_revisions": (content_revisions, REVISIONS),
    "assertion_lifecycle": (assertion_lifecycle, LIFECYCLE),
    "event_support": (event_support, SUPPORT),
    "alert_reconcile": (alert_reconcile, RECONCILE),
    "json_path_class": (json_path_class, JSON_CLASS),
    "queue_coalesce": (queue_coalesce, COALESCE),
    "topn_per_recipient": (topn_per_recipient, TOPN),
    "contiguous_prefix": (contiguous_prefix, PREFIX),
    "subscription_match": (subscription_match, SUBSCRIBED),
    "coalesce_window": (coalesce_window, WINDOWED),
    "assessment_hysteresis": (assessment_hysteresis, HYSTERESIS),
    "precision_by_threshold": (precision_by_threshold, PRECISION),
    "first_corroboration": (first_corroboration, CORROBORATION),
    "active_at_instant": (active_at_instant, ACTIVE),
    "agreement_report": (agreement_report, AGREEMENT),
    "coverage_matrix": (coverage_matrix, COVERAGE),
    "prior_context_range": (prior_context, PRIOR),
    "poisson_estimate": (poisson_estimate, POISSON),
    "haversine_topk": (sector_topk, SECTOR),
    "vector_segments": (vector_segments, SEGMENTS),
    "regex_tags": (regex_tags, REGEX_TAGS),
    "reported_counts_max": (reported_counts_max, REPORTED),
    "history_page": (history_page, PAGE),
    "timeline_union": (timeline_union, TIMELINE_UNION),
}
