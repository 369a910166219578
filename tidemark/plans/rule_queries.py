"""Upserts, narrowing, snapshots, feeds, signals and small rules over the driver's tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import plural, rounded
from ..functions.timeops import local_hour, text as stamped
from ..operators import archive as A, delivery as Q, evaluation as E, hierarchy as H, movement as M, reports as O, risk as K, states as S
from ..params import AnalyticsWindow, hour_band
from ..sources import feeds
from ..streaming import messages as L
from . import archive_queries, binding as B
from .binding import ARCHIVE_SQL as MC, LOCATIONS_SQL as LOC, TREE_SQL as TREE, r, stamp, with_sql
from .record_queries import EV, _events, _id

NOW = datetime(2024, 1, 25)


def _later(column: str, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(column) + minutes.cast("long") * 60_000_000)


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural keys of the second half of the events that the first half lacks."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 30).alias("a"), (F.col("k") % 30).alias("b"), "event_id")
    half = F.col("event_id") % 2 == 0
    return S.insert_new(rows.where(half), rows.where(~half), ["a", "b"]).select("a", "b")


INSERTED = f"WITH {EV}, x AS (SELECT user_id % 30 AS a, k % 30 AS b, event_id % 2 AS h FROM ev) SELECT DISTINCT a, b FROM x WHERE h = 1 EXCEPT SELECT a, b FROM x WHERE h = 0"


def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each key wins; an update of the same instant wins too, an older one doesn't."""
    rows = _events(spark, sf_dir).select((F.col("k") % 40).alias("key"), F.date_trunc("day", "ts").alias("at"), "event_id")
    newest = rows.groupBy("key", "at").agg(F.max("event_id").alias("event_id"))
    return S.monotone_upsert(newest.where("event_id % 3 = 0").groupBy("key").agg(F.max("at").alias("at"), F.max_by("event_id", "at").alias("event_id")), newest.where("event_id % 3 <> 0"), ["key"], "at").select("key", "event_id")


UPSERTED = f"""WITH {EV}, x AS (SELECT k % 40 AS key, date_trunc('day', ts) AS d, max(event_id) AS id FROM ev GROUP BY ALL)
SELECT key, id AS event_id FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY d DESC) = 1"""


def narrowed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two homonyms for each mention, of which the one under the named nation counts."""
    tree = H.closure(B.locations(spark, sf_dir))
    e = _events(spark, sf_dir)
    one = lambda n: F.struct(_id("c", n % 150).alias("candidate_id"), _id("n", F.col("k") % 25).alias("parent_id"))
    rows = e.select(F.col("event_id").alias("mention_id"), F.explode(F.array(one(F.col("event_id")), one(F.col("event_id") * 7 + 1))).alias("c")).select("mention_id", "c.*")
    return H.narrow(rows, tree)


NARROWED = f"""WITH {EV}, {LOC}, m AS (SELECT event_id, 'n' || (k % 25) AS p, unnest(['c' || (event_id % 150), 'c' || ((event_id * 7 + 1) % 150)]) AS c FROM ev), f AS (
  SELECT event_id, count(DISTINCT c) AS n, min(c) AS one FROM m JOIN loc ON id = c AND parent_id = p GROUP BY 1)
SELECT event_id AS mention_id, CASE WHEN n = 1 THEN one END AS location_id FROM ev LEFT JOIN f USING (event_id)"""


def scoped_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    named = e.select((F.col("user_id") % 12).alias("chat_id"), (F.col("k") % 20).alias("event_id"), _id("c", F.col("event_id") % 60).alias("location_id")).distinct()
    subscribed = e.where("event_id % 9 = 0").select((F.col("user_id") % 12).alias("chat_id"), _id("n", F.col("k") % 25).alias("location_id")).where("chat_id < 8").distinct()
    return H.scope_to_subscription(named, subscribed, H.closure(B.locations(spark, sf_dir)))


SCOPED = f"""WITH {EV}, {LOC}, {TREE}, n AS (SELECT DISTINCT user_id % 12 AS chat_id, k % 20 AS event_id, 'c' || (event_id % 60) AS location_id FROM ev),
s AS (SELECT DISTINCT user_id % 12 AS chat_id, 'n' || (k % 25) AS l FROM ev WHERE event_id % 9 = 0 AND user_id % 12 < 8),
w AS (SELECT DISTINCT chat_id, ancestor_id AS location_id FROM s JOIN tree ON descendant_id = l UNION SELECT chat_id, descendant_id FROM s JOIN tree ON ancestor_id = l),
j AS (SELECT n.*, w.chat_id IS NOT NULL AS hit FROM n LEFT JOIN w ON w.chat_id = n.chat_id AND w.location_id = n.location_id)
SELECT chat_id, event_id, location_id FROM j QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY chat_id, event_id)"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("k") * 5 + F.col("user_id") % 5).alias("event_id"), B.pick(("A", "B", "C", "C", "C"), F.col("user_id")).alias("tier"), B.pick(("rules", "rules", "model"), F.col("event_id")).alias("origin"), _id("g", F.col("event_id") % 4).alias("independence_group"), (F.col("event_id") % 29 == 0).alias("official"))
    return S.promotion(rows)


PROMOTIONS = f"""WITH {EV}, x AS (SELECT k * 5 + user_id % 5 AS event_id, count(DISTINCT CASE WHEN user_id % 5 < 2 AND event_id % 3 < 2 THEN event_id % 4 END) AS groups, bool_or(event_id % 29 = 0) AS o FROM ev GROUP BY 1)
SELECT event_id, groups, CASE WHEN o THEN 'official' WHEN groups >= 2 THEN 'confirmed' ELSE 'unverified' END AS level FROM x"""


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.status_histogram(B.load(spark, sf_dir, "events").select(F.col("event_type").alias("status"))).select(F.to_json("statuses").alias("statuses"))


HISTOGRAM = """SELECT '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS statuses FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""


def extrapolations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs along a meridian, where the way on is plain arithmetic; legs without way, time or sense are refused."""
    n = F.col("c_custkey")
    rows = B.load(spark, sf_dir, "customer").select("c_custkey", (F.lit(44.0) + n % 6).alias("lat1"), F.lit(30.0).alias("lon1"), (F.lit(44.0) + n % 6 + n % 4 / 10).alias("lat2"), F.lit(30.0).alias("lon2"), (n % 5 * 300).alias("seconds"))
    return M.extrapolated(rows, 30, 400).select("c_custkey", "refused", rounded(F.col("speed_kmh"), 3).alias("speed_kmh"), rounded(F.col("lat"), 5).alias("lat"), rounded(F.col("lon"), 5).alias("lon"))


EXTRAPOLATED = f"""WITH x AS (SELECT c_custkey, 44 + c_custkey % 6 + c_custkey % 4 / 10 AS lat2, radians(c_custkey % 4 / 10) * {M.EARTH_KM} AS km, c_custkey % 5 * 300 / 3600 AS h FROM customer),
y AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'no_leg' WHEN h = 0 THEN 'no_elapsed' WHEN km / h > 400 THEN 'implausible_speed' END AS refused, CASE WHEN h > 0 THEN km / h END AS v FROM x)
SELECT c_custkey, refused, {r("v", 3)} AS speed_kmh, CASE WHEN refused IS NULL THEN {r(f"lat2 + degrees(v / 2 / {M.EARTH_KM})", 5)} END AS lat, CASE WHEN refused IS NULL THEN 30.0::DOUBLE END AS lon FROM y"""


def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", plural(F.col("event_id") % 130, "загроза", "загрози", "загроз").alias("word"), plural(F.col("k"), "one", "few", "many").alias("form"))


PLURALS = f"""WITH {EV}, w AS (SELECT event_id, event_id % 130 AS a, k FROM ev)
SELECT event_id, CASE WHEN a IN (1, 21, 31, 41, 51, 61, 71, 81, 91, 101, 121) THEN 'загроза' WHEN a % 10 IN (2, 3, 4) AND a NOT IN (12, 13, 14, 112, 113, 114) THEN 'загрози' ELSE 'загроз' END AS word,
  CASE WHEN k IN (1, 21, 31, 41, 51, 61, 71, 81, 91) THEN 'one' WHEN k % 10 IN (2, 3, 4) AND k NOT IN (12, 13, 14) THEN 'few' ELSE 'many' END AS form FROM w"""


def expired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", B.pick(("active", "ended"), F.col("k")).alias("status"), _later("ts", F.col("k") * 120).alias("valid_until"))
    return S.expired(rows, NOW).select("event_id")


EXPIRED = f"WITH {EV} SELECT event_id FROM ev WHERE k % 2 = 0 AND ts + to_hours(k * 2) <= TIMESTAMP '{NOW}'"


def _snapshot(spark: SparkSession, sf_dir: str, even: bool) -> DataFrame:
    rows = _events(spark, sf_dir).where((F.col("event_id") % 2 == 0) == F.lit(even))
    return S.fold_snapshot(rows.select(_id("c", F.col("k") * 3 % 70).alias("location_id"), B.pick(("air", "artillery"), F.col("user_id")).alias("alert_type"), (F.col("user_id") % 5 > 2).alias("active"), F.col("ts").alias("started_at")))


def folded_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, True).withColumn("started_at", stamped(F.col("started_at")))


SNAP = f"{EV}, sn AS (SELECT 'c' || (k * 3 % 70) AS location_id, ['air', 'artillery'][user_id % 2 + 1] AS alert_type, user_id % 5 > 2 AS active, ts, event_id FROM ev)"
FOLDED = f"WITH {SNAP} SELECT location_id, alert_type, bool_or(active) AS active, {stamp('min(ts) FILTER (WHERE active)')} AS started_at FROM sn WHERE event_id % 2 = 0 GROUP BY ALL"


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("location_id") != "c3"
    return S.snapshot_changes(_snapshot(spark, sf_dir, True), _snapshot(spark, sf_dir, False).where(gone))


CHANGES = f"""WITH {SNAP}, a AS (SELECT DISTINCT location_id, alert_type FROM sn WHERE event_id % 2 = 0), b AS (SELECT DISTINCT location_id, alert_type FROM sn WHERE event_id % 2 = 1 AND location_id <> 'c3')
SELECT *, 'missing' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'appeared' FROM (FROM b EXCEPT FROM a)"""


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy((F.col("user_id") % 60).alias("source_id")).agg(F.max("ts").alias("t"))
    rows = rows.select("source_id", (F.col("source_id") % 7 > 0).alias("enabled"), F.when(F.col("source_id") % 5 > 0, F.col("t")).alias("last_success_at"))
    return S.freshness(rows, datetime(2024, 1, 30), 3600 * 8).select("source_id", "status")


FRESHNESS = """SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'disabled' WHEN source_id % 5 = 0 THEN 'never' WHEN t < TIMESTAMP '2024-01-30' - INTERVAL '8 hours' THEN 'stale' ELSE 'fresh' END AS status
FROM (SELECT user_id % 60 AS source_id, max(ts) AS t FROM events GROUP BY 1)"""


def generated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    place = lambda n, relation: F.struct(_id("c", n).alias("location_id"), F.lit(relation).alias("relation"))
    reports = e.select(F.col("event_id").alias("id"), B.pick(("A", "B", "C"), F.col("k")).alias("tier"), F.col("ts").alias("observed_at"), F.array(place(F.col("user_id") % 9, "explicit"), place(F.col("user_id") % 4, "mentioned")).alias("places"), F.when(F.col("k") % 2 == 0, F.array(F.lit("uav"), F.lit("mlrs"))).otherwise(F.array(F.lit("aviation"))).alias("classes"))
    return K.signals(reports).select("id", "location_id", "threat_type", "geographic_relevance", "contribution", stamped(F.col("expires_at")).alias("expires_at"))


SIGNALS = f"""WITH {EV}, x AS (SELECT event_id AS id, k, ts, unnest(['c' || (user_id % 9), 'c' || (user_id % 4)]) AS location_id, unnest([{K.RELEVANCE["explicit"]}, {K.RELEVANCE["mentioned"]}]::DOUBLE[]) AS geographic_relevance FROM ev)
SELECT id, location_id, unnest(CASE WHEN k % 2 = 0 THEN ['uav', 'mlrs'] ELSE ['aviation'] END) AS threat_type, geographic_relevance, {r(f"[{K.BASE['A']}, {K.BASE['B']}, {K.BASE['C']}][k % 3 + 1] * geographic_relevance", 3)} AS contribution, {stamp("ts + INTERVAL '6 hours'")} AS expires_at FROM x"""


def withdrawal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    events = e.select("event_id", B.pick(("model", "rules"), F.col("k")).alias("origin"), B.pick(("active", "active", "ended"), F.col("user_id")).alias("status"), F.lit("unverified").alias("evidence_level"), F.col("ts").alias("created_at"))
    evidence = e.select((F.col("event_id") - F.col("event_id") % 4).alias("event_id"), B.pick(("model", "rules"), F.col("user_id")).alias("origin"))
    return E.withdrawal_candidates(events, evidence, NOW, 30).select("event_id")


CANDIDATES = f"""WITH {EV} SELECT event_id FROM ev WHERE k % 2 = 0 AND user_id % 3 < 2 AND ts < TIMESTAMP '{NOW}' AND event_id NOT IN (SELECT event_id - event_id % 4 FROM ev WHERE user_id % 2 = 1) ORDER BY ts, event_id LIMIT 30"""


def late_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.col("ts").alias("published_at"), _later("ts", F.col("k")).alias("received_at"))
    return L.with_lateness(rows).select("event_id", "late")


LATE = f"WITH {EV} SELECT event_id, k >= 60 AS late FROM ev"


def hour_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each band of local hours."""
    hour = local_hour(F.col("ts"))
    bands = {band: hour_band(band, datetime(2024, 1, 30, 3)) for band in ("night", "day", "next12h")}
    named = F.array_compact(F.array(*(F.when(hour.isin(hours), F.lit(band)) for band, hours in bands.items())))
    return B.load(spark, sf_dir, "events").select(F.explode(named).alias("band")).groupBy("band").agg(F.count("*").alias("messages"))


BANDS = """SELECT band, count(*) AS messages FROM (SELECT hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv') AS h FROM events), (VALUES ('night', 22, 8), ('day', 6, 16), ('next12h', 5, 12)) b(band, first, n) WHERE (h - first + 24) % 24 < n GROUP BY 1"""


def feed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot bodies in three shapes, one for each event; some aren't JSON."""
    n, k = F.col("event_id"), F.col("k")
    own = F.concat(F.lit('{"regionId": "'), k.cast("string"), F.lit('", "regionName": "R'), k.cast("string"), F.lit('"'))
    nested = F.concat(own, F.lit(', "activeAlerts": [{"type": "AIR", "id": "x'), n.cast("string"), F.lit('"}, {"type": "ARTILLERY", "active": false, "id": "y'), n.cast("string"), F.lit('"}]}'))
    flat = F.concat(own, F.lit(', "status": "'), B.pick(("Ongoing", "over"), k), F.lit('", "id": "z'), n.cast("string"), F.lit('"}'))
    body = F.when(n % 4 == 0, F.concat(F.lit("["), nested, F.lit("]"))).when(n % 4 == 1, F.concat(F.lit('{"states": ['), flat, F.lit("]}"))).when(n % 4 == 2, F.concat(F.lit('{"data": ['), nested, F.lit(", "), flat, F.lit(", 5]}"))).otherwise(F.lit("no body"))
    return feeds.alert_snapshot(B.dealt(_events(spark, sf_dir).select("event_id", "k"), "event_id").select("event_id", body.alias("body"))).select("event_id", "location_key", "location_name", "alert_type", "active", "external_id")


FEED = f"""WITH {EV}, x AS (
  SELECT event_id, k, unnest(['air', 'artillery']) AS alert_type, unnest([true, false]) AS active, unnest(['x', 'y']) AS p FROM ev WHERE event_id % 4 IN (0, 2)
  UNION ALL SELECT event_id, k, 'air', k % 2 = 0, 'z' FROM ev WHERE event_id % 4 IN (1, 2))
SELECT event_id, k::VARCHAR AS location_key, 'R' || k AS location_name, alert_type, active, p || event_id AS external_id FROM x"""


def feed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that map ids to regions, and names to states."""
    k, n = F.col("k").cast("string"), F.col("event_id").cast("string")
    regions = F.concat(F.lit('{"'), n, F.lit('": {"alert": true, "districts": [{"name": "d'), k, F.lit('", "alert": '), (F.col("k") % 2 == 0).cast("string"), F.lit('}], "community": [{"name": "h", "alert": true}]}}'))
    names = F.concat(F.lit('{"'), n, F.lit('": "'), B.pick(("active", "none"), F.col("k")), F.lit('"}'))
    e = _events(spark, sf_dir)
    a = feeds.region_map(e.select(regions.alias("body"))).select(F.col("region_key").alias("key"), "level", "name", "active")
    b = feeds.name_map(e.select(names.alias("body"))).select(F.col("name").alias("key"), F.lit("named").alias("level"), "name", "active")
    return a.unionByName(b)


MAPS = f"""WITH {EV} SELECT event_id::VARCHAR AS key, 'district' AS level, 'd' || k AS name, k % 2 = 0 AS active FROM ev UNION ALL SELECT event_id::VARCHAR, 'hromada', 'h', true FROM ev
UNION ALL SELECT event_id::VARCHAR, 'named', event_id::VARCHAR, k % 2 = 0 FROM ev"""


def layer_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of GeoJSON bodies: rings and points of each polygon; points are none."""
    k = (F.col("k") % 50).cast("string")
    ring = F.concat(F.lit("[[0,0],["), k, F.lit(",0],["), k, F.lit(",1],[0,0]]"))
    body = F.concat(F.lit('{"features": [{"properties": {"name": "p'), k, F.lit('"}, "geometry": {"type": "Polygon", "coordinates": ['), ring, F.lit(']}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [['), ring, F.lit("],["), ring, F.lit(']]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}'))
    out = feeds.geojson_features(_events(spark, sf_dir).select(body.alias("body")))
    return out.select("n", "kind", F.col("properties")["name"].alias("name"), F.size("rings").alias("rings"), F.aggregate(F.flatten("rings"), F.lit(0.0), lambda a, p: a + p[0]).alias("sum_x"))


LAYERS = f"""WITH {EV} SELECT unnest([0, 1])::INT AS n, unnest(['Polygon', 'MultiPolygon']) AS kind, unnest(['p' || (k % 50), 'm']) AS name, unnest([1, 2])::INT AS rings, unnest([2, 4]) * (k % 50)::DOUBLE AS sum_x FROM ev"""


def notification_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each chat is told of what; the fold has no SQL."""
    e = _events(spark, sf_dir)
    rows = e.select((F.col("user_id") % 15).alias("chat_id"), (F.col("k") % 12).alias("event_id"), F.col("ts").alias("at"), B.pick(Q.EVIDENCE_LEVELS, F.col("event_id")).alias("evidence_level"), B.pick(("uav", "mlrs"), F.floor(F.col("value") / 30).cast("long")).alias("threat_type"), F.array(_id("c", F.col("k") % 5)).alias("location_ids"), _later("ts", F.col("k")).alias("valid_until"), F.col("event_id").alias("tie"))
    return Q.threat_decisions(rows, "tie").groupBy("chat_id", "action").agg(F.count("*").alias("times"))


#: A count of each slice that is added up.
MEASURES = {"threat_dynamics": "messages", "geography_shift": "current_messages", "loss_points": "withdrawals", "source_performance": "messages", "composition_share": "messages", "archive_coverage": "messages"}


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each slice of the strategic overview, and the sum of one of its counts."""
    places = B.locations(spark, sf_dir)
    tables = {"archive": B.archive(spark, sf_dir), "bridge": B.bridge(spark, sf_dir), "locations": places, "regions": H.rollup(places, H.closure(places)), "assertions": B.assertions(spark, sf_dir), "sources": B.sources(spark, sf_dir)}
    slices = A.strategic_overview(tables, B.WINDOW, B.LOSS_WINDOW)
    counted = [rows.agg(F.count("*").alias("rows"), F.sum(MEASURES[name]).cast("long").alias("total")).select(F.lit(name).alias("slice"), "rows", "total") for name, rows in slices.items()]
    return reduce(DataFrame.unionByName, counted)


OVERVIEW = " UNION ALL ".join(f"SELECT '{name}' AS slice, count(*) AS rows, sum({measure})::BIGINT AS total FROM ({archive_queries.QUERIES[name][1]})" for name, measure in MEASURES.items())


QUERIES = {
    "inserted_rows": (inserted_rows, INSERTED),
    "upserted_rows": (upserted_rows, UPSERTED),
    "narrowed_places": (narrowed_places, NARROWED),
    "scoped_places": (scoped_places, SCOPED),
    "promotions": (promotions, PROMOTIONS),
    "status_histogram": (status_histogram, HISTOGRAM),
    "extrapolations": (extrapolations, EXTRAPOLATED),
    "plural_forms": (plural_forms, PLURALS),
    "expired_events": (expired_events, EXPIRED),
    "folded_snapshot": (folded_snapshot, FOLDED),
    "snapshot_changes": (snapshot_changes, CHANGES),
    "source_freshness": (source_freshness, FRESHNESS),
    "generated_signals": (generated_signals, SIGNALS),
    "withdrawal_candidates": (withdrawal_candidates, CANDIDATES),
    "late_messages": (late_messages, LATE),
    "hour_bands": (hour_bands, BANDS),
    "feed_alerts": (feed_alerts, FEED),
    "feed_maps": (feed_maps, MAPS),
    "layer_outlines": (layer_outlines, LAYERS),
    "notification_actions": (notification_actions, None),
    "overview": (overview, OVERVIEW),
}
