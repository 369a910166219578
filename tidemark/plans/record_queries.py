"""Writes, timing, territories, details and what is told of a place, over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import timing as T
from ..functions.numbers import rounded
from ..functions.timeops import instant, text as stamped
from ..operators import hierarchy as H, places as P, records as W, research as Y
from . import binding as B
from .binding import ARCHIVE_SQL as MC, BRIDGE_SQL as BR, LOCATIONS_SQL as LOC, REGIONS_SQL as REG, TREE_SQL as TREE, r, stamp, with_sql

NOW = datetime(2024, 1, 30)
EV = "ev AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# --- writes


def log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.versioned_log(B.load(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 100).select("event_id", "version")


LOG = "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS version FROM events"


def outbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by place to chats by place; what chat 3 should get has been sent."""
    e = _events(spark, sf_dir)
    events = e.select("event_id", (F.col("k") % 7).alias("place"))
    chats = e.select((F.col("user_id") % 9).alias("recipient_id"), (F.col("user_id") % 7).alias("place")).unionByName(e.select((F.col("user_id") % 9).alias("recipient_id"), (F.col("user_id") % 5).alias("place"))).distinct()
    sent = e.select(F.concat(F.lit("3:"), F.col("event_id").cast("string")).alias("idempotency_key"))
    return W.outbox(events, chats, ["place"], sent)


OUTBOX = f"""WITH {EV}, ch AS (SELECT DISTINCT user_id % 9 AS c, unnest([user_id % 7, user_id % 5]) AS place FROM ev)
SELECT DISTINCT c || ':' || event_id AS idempotency_key, c AS recipient_id, event_id FROM ev JOIN ch ON place = k % 7 WHERE c <> 3"""


def archived_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the new verdicts; those of every third message and first version are archived already."""
    e = _events(spark, sf_dir)
    rows = e.select(F.floor(F.col("event_id") / 2).alias("message_id"), (F.col("event_id") % 2).alias("version"), F.array(_id("c", F.col("k") % 5), _id("c", F.col("k") % 3)).alias("asserted_places"), F.when(F.col("k") % 2 == 0, F.array(_id("n", F.col("k") % 4))).alias("retracted_places"))
    return W.archive_verdicts(rows, rows.where("message_id % 3 = 0 AND version = 0"))[1]


VERDICTS = f"""WITH {EV}, v AS (SELECT event_id // 2 AS message_id, event_id % 2 AS version, k FROM ev WHERE NOT ((event_id // 2) % 3 = 0 AND event_id % 2 = 0))
SELECT DISTINCT message_id, version, unnest(['c' || (k % 5), 'c' || (k % 3)]) AS location_id, 'asserted' AS role FROM v UNION ALL SELECT message_id, version, 'n' || (k % 4), 'retracted' FROM v WHERE k % 2 = 0"""


def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the reason why it is refused, null for accepted ones."""
    e = _events(spark, sf_dir)
    known = e.where("event_id % 11 <> 0").select("event_id", B.pick(("unverified", "official", "confirmed"), F.col("k")).alias("evidence"), B.pick(("rules", "rules", "model"), F.col("user_id")).alias("origin"), B.pick(("uav", "mlrs", None), F.col("k")).alias("threat_type"))
    accepted, refused = W.guarded_insert(e.select("event_id", B.pick(("uav", "mlrs", None), F.col("user_id")).alias("seen_type")), known)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(refused).select("event_id", "reason")


GUARDED = f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN k % 3 = 1 THEN 'official' WHEN user_id % 3 = 2 THEN 'not_rules' WHEN k % 3 <> user_id % 3 THEN 'changed' END AS reason FROM ev"""


def queue_after_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    queue = e.select("event_id", (F.col("user_id") % 20).alias("recipient_id"), B.pick(("user", "channel"), F.col("k")).alias("kind"))
    return W.after_deletions(queue, spark.range(0, 20, 3).select(F.col("id").alias("user_id")))


DELETIONS = f"WITH {EV} SELECT event_id, user_id % 20 AS recipient_id, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'channel' END AS kind FROM ev WHERE k % 2 = 1 OR user_id % 20 % 3 <> 0"


def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.retained(B.load(spark, sf_dir, "events").select("event_id", "ts"), "ts", NOW, 12).select("event_id")


RETAINED = f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW - timedelta(days=12)}'"


def decayed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    signals = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("source_id"), (F.col("k") % 30).alias("event_id"), F.col("value").alias("contribution"))
    out = W.decayed(signals, signals.where("contribution > 40").select("source_id", "event_id"), 0.25)
    return out.select("id", rounded(F.col("contribution")).alias("contribution"), "decayed")


DECAYED = f"""WITH {EV}, s AS (SELECT event_id AS id, user_id % 10 AS src, k % 30 AS e, value FROM ev), w AS (SELECT DISTINCT src, e FROM s WHERE value > 40)
SELECT id, {r("CASE WHEN w.e IS NULL THEN value ELSE value * 0.25 END")} AS contribution, w.e IS NOT NULL AS decayed FROM s LEFT JOIN w ON w.src = s.src AND w.e = s.e"""


def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.published_by(B.load(spark, sf_dir, "events").select("event_id", "ts"), "ts", NOW, timedelta(days=3), datetime(2024, 1, 28)).select("event_id")


PUBLISHED = "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-28'"


def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("version"), "event_type")
    return W.replayed(rows.where("version % 3 <> 0"), rows.where("version % 3 <> 1"), 50)


REPLAYED = "SELECT event_id AS version, event_type FROM events WHERE event_id > 50"


def stuck_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select("event_id", F.col("ts").alias("started_at"), F.when(F.col("k") % 3 == 0, F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 3_600_000_000)).alias("ended_at"))
    return W.stuck(rows, NOW, timedelta(hours=36)).select("event_id", stamped(F.col("ended_at")).alias("ended_at"), "reason")


STUCK = f"""WITH {EV}, x AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN ts + to_hours(k) END AS e, ts + INTERVAL '36 hours' AS b FROM ev)
SELECT event_id, {stamp(f"CASE WHEN e IS NULL AND b < TIMESTAMP '{NOW}' THEN b ELSE e END")} AS ended_at, CASE WHEN e IS NULL AND b < TIMESTAMP '{NOW}' THEN 'stuck' END AS reason FROM x"""


def withdrawal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    known = e.where("event_id % 5 <> 0").select("event_id", B.pick(("model", "rules"), F.col("k")).alias("origin"), B.pick(("observed", "expired", "active"), F.col("user_id")).alias("status"))
    return W.withdrawal_outcome(e.select("event_id"), known)


OUTCOMES = f"WITH {EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_found' WHEN k % 2 = 1 THEN 'not_model' WHEN user_id % 3 = 1 THEN 'not_live' ELSE 'withdrawn' END AS outcome FROM ev"


def claim_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    queue = e.select("event_id", F.col("event_id").alias("id"), B.pick(("pending", "sent"), F.col("k")).alias("status"), F.when(F.col("k") % 3 == 0, F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 86_400_000_000)).alias("not_before"), (F.col("k") % 4).alias("priority"), F.when(F.col("user_id") % 2 == 0, F.col("ts")).alias("last_tried_at"), F.col("ts").alias("created_at"))
    return W.claimable(queue, NOW, 40).select("event_id")


CLAIMS = f"""WITH {EV} SELECT event_id FROM ev WHERE k % 2 = 0 AND (k % 3 <> 0 OR ts + to_days(k::INT) <= TIMESTAMP '{NOW}')
ORDER BY k % 4, CASE WHEN user_id % 2 = 0 THEN ts END NULLS FIRST, ts, event_id LIMIT 40"""


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", W.backoff_seconds(F.col("k"), 5, 120).alias("wait_seconds"), T.numeric_id(F.concat(F.when(F.col("k") % 4 == 0, F.lit("x")).otherwise(F.lit("")), F.col("event_id").cast("string"))).alias("external_number"))


BACKOFF = f"WITH {EV} SELECT event_id, least(5 * pow(2, least(k, 30)), 120)::BIGINT AS wait_seconds, CASE WHEN k % 4 <> 0 THEN event_id END AS external_number FROM ev"


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one class and place within half an hour are one event."""
    e = _events(spark, sf_dir)
    rows = e.select(F.col("event_id").cast("string").alias("id"), _id("t", F.col("k") % 12).alias("threat_type"), F.col("ts").alias("published_at"), F.array(_id("p", F.col("user_id") % 6), _id("p", F.col("k") % 5)).alias("places"))
    return W.merged_events(rows, 24 * 3600).select("id", "event_key", "created")


# --- timing and small columns


def expected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timing = B.pick(T.TIMINGS, F.col("k"))
    other = B.pick(T.TIMINGS, F.col("user_id"))
    w = T.expected_window(timing, F.col("ts"))
    return _events(spark, sf_dir).select("event_id", stamped(w["since"]).alias("since"), stamped(w["until"]).alias("until"), T.nearer_timing(timing, other).alias("nearer"), T.freshness_bucket(F.col("ts"), instant(datetime(2024, 1, 15, 12))).alias("fresh"))


LOCAL = "AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv'"
EVENING = "(date_trunc('day', ts {0}) + INTERVAL '{1}') AT TIME ZONE 'Europe/Kyiv' AT TIME ZONE 'UTC'"
WINDOWS = f"""WITH {EV}, x AS (SELECT *, ['now', 'within_hour', 'evening', 'within_day', 'within_two_days'] AS t, [30, 90, 360, 1440, 2880] AS m, {EVENING.format(LOCAL, "18 hours")} AS six, {EVENING.format(LOCAL, "1439 minutes")} AS night FROM ev), y AS (
  SELECT *, CASE WHEN k % 5 = 2 THEN greatest(ts, six) ELSE ts END AS since FROM x)
SELECT event_id, {stamp("since")} AS since, {stamp("CASE WHEN k % 5 <> 2 THEN ts + to_minutes(m[k % 5 + 1]) WHEN night > since THEN night ELSE since + to_minutes(360) END")} AS until,
  t[least(k % 5, user_id % 5) + 1] AS nearer, (CASE WHEN a < 10 THEN 3 WHEN a < 30 THEN 2 WHEN a < 120 THEN 1 ELSE 0 END)::INT AS fresh FROM (SELECT *, greatest(epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts), 0) / 60e6 AS a FROM y)"""


def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _events(spark, sf_dir), F.col("event_id")
    link = T.message_link(F.when(n % 3 == 0, _id("@chan", F.col("k"))), F.when(n % 2 == 0, n.cast("string")).otherwise(F.lit("a1")), F.when(n % 5 == 0, F.lit("ftp://x")).otherwise(F.lit(" HTTPS://x.example ")))
    return e.select("event_id", link.alias("link"))


LINKS = f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'https://t.me/chan' || k || '/' || event_id WHEN event_id % 3 = 0 THEN 'https://t.me/chan' || k WHEN event_id % 5 <> 0 THEN 'HTTPS://x.example' END AS link FROM ev"""


# --- places


def territory_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select(_id("e", F.col("event_id") % 200).alias("event_id"), _id("c", F.col("event_id") % 150).alias("location_id"), B.pick(("uav", "mlrs"), F.col("event_id") % 200).alias("threat_type"), B.pick(P.RELATIONS, F.col("k")).alias("relation"), B.pick(P.EVIDENCE, F.col("event_id") % 200).alias("evidence"), F.when(F.col("event_id") % 3 > 0, _id("d", F.col("event_id") % 200)).alias("direction"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("event_id") % 200 * 37 % 90) * 60_000_000).alias("observed_at"))
    out = P.territory_state(rows.where("direction IS NOT NULL"), H.closure(B.locations(spark, sf_dir)))
    return out.select("territory_id", "threat_type", "relation", "evidence", "coverage", "events", stamped(F.col("last_at")).alias("last_at"), "direction", F.array_join("event_ids", ",").alias("event_ids"), "asserted")


TERRITORY = f"""WITH {EV}, {LOC}, {TREE}, t AS (
  SELECT event_id % 200 AS n, 'c' || (event_id % 150) AS location_id, k % 4 AS r FROM ev WHERE event_id % 3 > 0
), x AS (
  SELECT ancestor_id AS territory_id, n, max(r) AS r, max((depth = 0)::INT) AS c FROM t JOIN tree ON descendant_id = location_id GROUP BY ALL
), y AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'uav' ELSE 'mlrs' END AS threat_type, n % 4 AS e, to_timestamp(1700000000 + n * 37 % 90 * 60) AT TIME ZONE 'UTC' AS o, 'e' || n AS id FROM x)
SELECT territory_id, threat_type, ['mentioned', 'aftermath', 'reported_direction', 'explicit_threat'][max(r) + 1] AS relation, ['unverified', 'monitoring', 'confirmed', 'official'][max(e) + 1] AS evidence,
  CASE max(c) WHEN 1 THEN 'direct' ELSE 'partial' END AS coverage, count(*) AS events, {stamp("max(o)")} AS last_at, 'd' || substr(arg_max(id, (o, id)), 2) AS direction, array_to_string(list(id ORDER BY o DESC, id)[1:8], ',') AS event_ids, max(r) > 0 AS asserted
FROM y GROUP BY ALL"""


def region_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir)
    chats = _events(spark, sf_dir).select((F.col("user_id") % 50).alias("chat_id"), _id("c", F.col("k") % 150).alias("location_id"))
    return P.subscribers_by_region(chats, H.rollup(places, H.closure(places)))


SUBSCRIBERS = f"WITH {EV}, {LOC}, {REG} SELECT region_id, count(DISTINCT user_id % 50) AS chats FROM ev JOIN reg ON location_id = 'c' || (k % 150) GROUP BY 1"


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles: area, centroid, whether they meet a box, and how many points are left of an untidy copy."""
    n = F.col("c_custkey")
    x, y, w, h = n % 40, n % 23, n % 5 + 1, n % 3 + 1
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    untidy = F.concat(F.array(at(F.lit(500), F.lit(0))), ring, F.slice(ring, 4, 1), F.slice(ring, 1, n % 2))
    box = P.bounds(F.array(at(F.lit(10), F.lit(5)), at(F.lit(20), F.lit(9))))
    # the file may be one row group: rows are dealt before the work, and rings are columns, computed once a row
    rows = B.load(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey").withColumns({"ring": ring, "untidy": untidy}).withColumn("c", P.centroid(F.col("ring")))
    return rows.select("c_custkey", P.ring_area(F.col("ring")).alias("area"), "c.x", "c.y", P.bounds_overlap(P.bounds(F.col("ring")), box).alias("meets"), F.size(P.sane_ring(F.col("untidy"))).alias("points"))


OUTLINES = """SELECT c_custkey, (w * h)::DOUBLE AS area, x + w / 2 AS x, y + h / 2 AS y, x <= 20 AND x + w >= 10 AND y <= 9 AND y + h >= 5 AS meets, 5 AS points
FROM (SELECT c_custkey, c_custkey % 40 AS x, c_custkey % 23 AS y, c_custkey % 5 + 1 AS w, c_custkey % 3 + 1 AS h FROM customer)"""


def upstream_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = H.related(H.closure(B.locations(spark, sf_dir)), spark.createDataFrame([("n3",)], "id string"))
    return Y.upstream(B.archive(spark, sf_dir), B.bridge(spark, sf_dir), near)


UPSTREAM = with_sql(MC, BR, LOC, TREE) + """, near AS (SELECT ancestor_id AS id FROM tree WHERE descendant_id = 'n3' UNION SELECT descendant_id FROM tree WHERE ancestor_id = 'n3')
SELECT z.location_id, count(*) AS occurrences FROM mc JOIN br z ON z.classification_id = mc.id AND z.role = 'retracted' JOIN br a ON a.classification_id = mc.id AND a.role = 'asserted'
WHERE decision = 'redirect' AND a.location_id IN (FROM near) AND z.location_id NOT IN (FROM near) GROUP BY 1"""


def recommended_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = B.load(spark, sf_dir, "supplier").select(_id("ch", F.col("s_suppkey")).alias("channel_id"), F.when(F.col("s_suppkey") % 4 > 0, _id("n", F.col("s_nationkey"))).alias("location_id"))
    near = H.related(H.closure(B.locations(spark, sf_dir)), B.load(spark, sf_dir, "nation").select(_id("n", F.col("n_nationkey")).alias("id")))
    return Y.recommended_channels(channels, near)


CHANNELS = f"""WITH {LOC}, {TREE}, near AS (SELECT 'n' || n_nationkey AS root, ancestor_id AS id FROM nation JOIN tree ON descendant_id = 'n' || n_nationkey UNION SELECT 'n' || n_nationkey, descendant_id FROM nation JOIN tree ON ancestor_id = 'n' || n_nationkey)
SELECT DISTINCT root AS location_id, 'ch' || s_suppkey AS channel_id FROM near JOIN supplier ON s_suppkey % 4 = 0 OR 'n' || s_nationkey = id"""


# --- what is told


def band_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By dimension, with the band's class of each row, as if the first hour's classes were seen now."""
    rows = Y.band_evidence(B.archive(spark, sf_dir).where(F.col("decision").isin("event_created", "redirect")), [22, 23, 0, 1, 2, 3, 4, 5])
    total = rows.where("dimension = 'total'").select(F.col("in_band").alias("all_in_band"))
    return rows.join(F.broadcast(total), F.lit(True)).select("dimension", "key", "in_band", "messages", Y.band_class(F.col("key") == "00", F.col("in_band"), F.col("all_in_band")).alias("band"))


BAND = with_sql(MC) + """, m AS (SELECT *, hour(published_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv') AS h FROM mc WHERE decision IN ('event_created', 'redirect')
), d AS (SELECT 'total' AS dimension, 'all' AS key, h FROM m UNION ALL SELECT 'hour', lpad(h::VARCHAR, 2, '0'), h FROM m UNION ALL SELECT 'version', classifier_version, h FROM m
  UNION ALL SELECT 'class', unnest(CASE WHEN len(candidate_threat_types) > 0 THEN candidate_threat_types ELSE [coalesce(threat_type, 'unknown')] END), h FROM m
), c AS (SELECT dimension, key, count(*) FILTER (WHERE h >= 22 OR h < 6) AS in_band, count(*) AS messages FROM d GROUP BY ALL)
SELECT *, CASE WHEN key = '00' THEN 'observed_now' WHEN in_band >= 3 AND in_band / (SELECT in_band FROM c WHERE dimension = 'total') >= 0.15 THEN 'typical' WHEN in_band >= 1 THEN 'atypical' ELSE 'never' END AS band FROM c"""


def rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.rolling_counts(B.archive(spark, sf_dir), datetime(2024, 1, 20))


ROLLING = with_sql(MC) + "SELECT " + ", ".join(f"count(*) FILTER (WHERE a < {h}) AS messages_{h}h, count(*) FILTER (WHERE a < {h} AND created_event) AS events_{h}h" for h in (3, 6, 12)) + " FROM (SELECT *, epoch(TIMESTAMP '2024-01-20') / 3600 - epoch(published_at) / 3600 AS a FROM mc) WHERE a >= 0"


def zone_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.archive(spark, sf_dir).withColumn("origin_zone", F.when(F.col("withdrawn_assertions") < 2, B.pick(("black_sea", "azov_sea"), F.col("withdrawn_assertions"))))
    out = Y.zone_activity(rows, datetime(2024, 1, 29), 24 * 60)
    return out.select("origin_zone", F.array_join("threat_types", ",").alias("threat_types"), stamped(F.col("last_reported_at")).alias("last_at"), "reports", "sources")


ZONES = with_sql(MC) + f"""SELECT ['black_sea', 'azov_sea'][withdrawn_assertions + 1] AS origin_zone, string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS threat_types, {stamp("max(published_at)")} AS last_at, count(*) AS reports, count(DISTINCT source_id) AS sources
FROM mc WHERE withdrawn_assertions < 2 AND published_at > TIMESTAMP '2024-01-28' GROUP BY 1"""


def model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    events = e.select((F.col("k") % 40).alias("event_id"), F.when(F.col("k") % 40 % 3 == 0, F.lit("model")).otherwise(F.lit("rules")).alias("origin"))
    return Y.model_signal_counts(e.select((F.col("user_id") % 40).alias("event_id"), F.col("event_type").alias("signal_type")), events)


MODEL_SIGNALS = f"WITH {EV} SELECT event_type AS signal_type, count(*) AS signals FROM ev WHERE user_id % 40 IN (SELECT k % 40 FROM ev WHERE k % 40 % 3 = 0) GROUP BY 1"


def verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.archive(spark, sf_dir).select(F.col("source_message_id").alias("message_id"), "classifier_version", "decision")
    return Y.verdict_changes(a.where("classifier_version = 'v1' AND decision <> 'redirect'"), a.where("classifier_version = 'v2'"))


CHANGES = with_sql(MC) + """SELECT was, became, count(*) AS messages FROM (SELECT source_message_id AS m, decision AS was FROM mc WHERE classifier_version = 'v1' AND decision <> 'redirect')
FULL JOIN (SELECT source_message_id AS m, decision AS became FROM mc WHERE classifier_version = 'v2') USING (m) WHERE was IS DISTINCT FROM became GROUP BY ALL"""


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(_id("n", F.col("user_id") % 25).alias("region_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), B.pick(("pending", "running", "done", "failed", "draft"), F.col("k")).alias("status"))
    return Y.latest_states(rows.where("region_id <> 'n4' OR status <> 'done'"))


LATEST_REPORTS = f"""WITH {EV}, x AS (SELECT 'n' || (user_id % 25) AS region_id, event_id AS id, ts, k % 5 AS s FROM ev WHERE user_id % 25 <> 4 OR k % 5 <> 2)
SELECT region_id, arg_max(id, (ts, id)) AS latest, arg_max(id, (ts, id)) FILTER (WHERE s < 2) AS pending, arg_max(id, (ts, id)) FILTER (WHERE s IN (2, 3)) AS terminal FROM x GROUP BY 1"""


def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("event_key", F.col("k") * 40 + F.col("user_id") % 40)
    events = e.select((F.col("event_key") - F.col("event_key") % 2).alias("event_id")).distinct()
    places = e.where("event_id % 3 = 0").select(F.col("event_key").alias("event_id"), _id("c", F.col("event_id") % 4).alias("location_id"), F.lit("asserted").alias("role"))
    evidence = e.where("event_id % 2 = 0").select(F.col("event_key").alias("event_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("source_id"))
    return Y.event_details(events, places, evidence)


DETAILS = f"""WITH {EV}, x AS (SELECT *, k * 40 + user_id % 40 AS e FROM ev), p AS (SELECT e, '[' || string_agg(DISTINCT '{{"location_id":"c' || (event_id % 4) || '","role":"asserted"}}', ',' ORDER BY '{{"location_id":"c' || (event_id % 4) || '","role":"asserted"}}') || ']' AS places FROM x WHERE event_id % 3 = 0 GROUP BY 1
), v AS (SELECT e, '[' || string_agg('{{"id":' || event_id || ',"source_id":' || (user_id % 10) || '}}', ',' ORDER BY ts, event_id) || ']' AS evidence, count(*) AS n FROM x WHERE event_id % 2 = 0 GROUP BY 1)
SELECT d.event_id, coalesce(places, '[]') AS places, coalesce(evidence, '[]') AS evidence, coalesce(n, 0) AS n_evidence FROM (SELECT DISTINCT e - e % 2 AS event_id FROM x) d LEFT JOIN p ON p.e = event_id LEFT JOIN v ON v.e = event_id"""


def movement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select((F.col("k") % 10).alias("event_id"), (F.col("user_id") % 3).alias("source_id"), F.date_trunc("hour", "ts").alias("at"), F.col("event_id").alias("id"))
    return Y.movement_facts(rows).select("event_id", "source_id", "id", "n")


MOVES = f"""WITH {EV}, x AS (SELECT k % 10 AS event_id, user_id % 3 AS source_id, date_trunc('hour', ts) AS h, min(event_id) AS id FROM ev GROUP BY ALL)
SELECT event_id, source_id, id, row_number() OVER (PARTITION BY event_id ORDER BY h DESC, id) AS n FROM x QUALIFY n <= 12"""


def night_debrief(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.archive(spark, sf_dir).select("threat_type", F.when(F.col("withdrawn_assertions") > 0, F.col("withdrawn_assertions") * 10 + F.length("id")).alias("count"), "source_id", "published_at")
    return Y.debrief(rows, datetime(2024, 1, 10, 18), datetime(2024, 1, 12, 6)).withColumns({c: stamped(F.col(c)) for c in ("first_at", "last_at")})


DEBRIEF = with_sql(MC) + f"""SELECT threat_type, count(*) AS messages, max(CASE WHEN withdrawn_assertions > 0 THEN withdrawn_assertions * 10 + length(id) END) AS peak, count(DISTINCT source_id) AS sources, {stamp("min(published_at)")} AS first_at, {stamp("max(published_at)")} AS last_at
FROM mc WHERE published_at BETWEEN TIMESTAMP '2024-01-10 18:00:00' AND TIMESTAMP '2024-01-12 06:00:00' GROUP BY 1"""

QUERIES = {
    "log_versions": (log_versions, LOG),
    "outbox_rows": (outbox_rows, OUTBOX),
    "archived_verdicts": (archived_verdicts, VERDICTS),
    "guarded_rows": (guarded_rows, GUARDED),
    "queue_after_deletions": (queue_after_deletions, DELETIONS),
    "retained_rows": (retained_rows, RETAINED),
    "decayed_signals": (decayed_signals, DECAYED),
    "published_rows": (published_rows, PUBLISHED),
    "replayed_log": (replayed_log, REPLAYED),
    "stuck_states": (stuck_states, STUCK),
    "withdrawal_outcomes": (withdrawal_outcomes, OUTCOMES),
    "claim_queue_head": (claim_queue_head, CLAIMS),
    "retry_backoff": (retry_backoff, BACKOFF),
    "merged_events": (merged_events, None),
    "expected_windows": (expected_windows, WINDOWS),
    "message_links": (message_links, LINKS),
    "territory_states": (territory_states, TERRITORY),
    "region_subscribers": (region_subscribers, SUBSCRIBERS),
    "outlines": (outlines, OUTLINES),
    "upstream_places": (upstream_places, UPSTREAM),
    "recommended_channels": (recommended_channels, CHANNELS),
    "band_evidence": (band_evidence, BAND),
    "rolling_counts": (rolling_counts, ROLLING),
    "zone_activity": (zone_activity, ZONES),
    "model_signals": (model_signals, MODEL_SIGNALS),
    "verdict_changes": (verdict_changes, CHANGES),
    "latest_reports": (latest_reports, LATEST_REPORTS),
    "event_details": (event_details, DETAILS),
    "movement_facts": (movement_facts, MOVES),
    "night_debrief": (night_debrief, DEBRIEF),
}
