"""Waves, periods, tactics, trust and risk over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import rounded
from ..functions.timeops import instant, within
from ..operators import archive as A, hierarchy as H, risk as R, tactics as T, trust as S, waves as V
from ..params import PeriodWindow, TacticsWindows
from . import binding as B
from .archive_queries import ASSERTING
from .binding import ARCHIVE_SQL as MC, ASSERTIONS_SQL as TA, BRIDGE_SQL as BR, LOCATIONS_SQL as LOC, REGIONS_SQL as REG, SOURCES_SQL as SRC, r, span, stamp, with_sql

AS_OF = datetime(2024, 1, 30)
P, TW = PeriodWindow.resolve("week", AS_OF), TacticsWindows.resolve(AS_OF)
TRUST_AS_OF = datetime(2000, 1, 1)
LOCAL_HOUR = "hour(published_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv')"


def _period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of the messages."""
    rows = B.archive(spark, sf_dir)
    return rows.where(within(F.col("published_at"), P.start, P.end) & F.col("decision").isin(*A.ASSERTING))


#: Each source has its own timeline and its own silences.
BY = ("source_id",)


def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.timeline(_period(spark, sf_dir), P.bucket_minutes, BY).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("at", "first_at", "last_at")})


CLASSES = "CASE WHEN len(candidate_threat_types) > 0 THEN candidate_threat_types ELSE [coalesce(threat_type, 'unknown')] END"
POINTS = f"""m AS (
  SELECT *, time_bucket(INTERVAL '15 minutes', published_at, TIMESTAMP '2000-01-01') AS slot FROM mc WHERE {span("published_at", P.start, P.end)} AND decision IN {ASSERTING}
), typed AS (SELECT source_id, slot, published_at, created_event, unnest({CLASSES}) AS threat_type FROM m), points AS (
  SELECT source_id, slot, NULL::VARCHAR AS threat_type, count(*) AS messages, count(*) FILTER (WHERE created_event) AS events_raised, min(published_at) AS first_at, max(published_at) AS last_at FROM m GROUP BY source_id, slot
  UNION ALL SELECT source_id, slot, threat_type, count(*), count(*) FILTER (WHERE created_event), min(published_at), max(published_at) FROM typed GROUP BY source_id, slot, threat_type
)"""
TIMELINE = with_sql(MC, POINTS) + f"SELECT source_id, {stamp('slot')} AS \"at\", threat_type, messages, events_raised, {stamp('first_at')} AS first_at, {stamp('last_at')} AS last_at FROM points"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.waves(V.timeline(_period(spark, sf_dir), P.bucket_minutes, BY), keys=BY)
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "ended_at")})


WAVE_PARTS = """s AS (SELECT *, coalesce(epoch(first_at) - epoch(lag(last_at) OVER (PARTITION BY source_id ORDER BY slot)) > 5400, true) AS begins FROM points WHERE threat_type IS NULL
), n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY source_id ORDER BY slot)::BIGINT AS wave FROM s
), w AS (SELECT source_id, wave, min(first_at) AS started_at, max(last_at) AS ended_at, sum(messages)::BIGINT AS messages, sum(events_raised)::BIGINT AS events_raised FROM n GROUP BY source_id, wave HAVING sum(messages) >= 2)"""
WAVES = with_sql(MC, POINTS, WAVE_PARTS) + f"SELECT source_id, wave, {stamp('started_at')} AS started_at, {stamp('ended_at')} AS ended_at, messages, events_raised, {r('epoch(ended_at) - epoch(started_at)', 1)} AS seconds FROM w"


def repeated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated_pairs(V.wave_classes(V.timeline(_period(spark, sf_dir), P.bucket_minutes, BY), keys=BY), keys=BY)


REPEATED_PAIRS = with_sql(MC, POINTS, WAVE_PARTS) + """, c AS (
  SELECT DISTINCT source_id, wave, p.threat_type FROM points p JOIN n USING (source_id, slot) SEMI JOIN w USING (source_id, wave) WHERE p.threat_type IS NOT NULL AND p.threat_type NOT IN ('unknown', 'combined')
)
SELECT a.threat_type AS a, b.threat_type AS b, count(*) AS waves FROM c a JOIN c b ON a.source_id = b.source_id AND a.wave = b.wave AND a.threat_type < b.threat_type GROUP BY ALL HAVING count(*) >= 2 ORDER BY waves DESC, a, b LIMIT 6"""


def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hour_histogram(_period(spark, sf_dir))


HOURS = f"hours AS (SELECT h.hour::INT AS hour, count(m.id) AS messages FROM range(24) h(hour) LEFT JOIN m ON {LOCAL_HOUR} = h.hour GROUP BY 1)"
HOUR_HISTOGRAM = with_sql(MC, POINTS, HOURS) + "SELECT * FROM hours"


def night_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.night_share(V.hour_histogram(_period(spark, sf_dir)))


NIGHT_SHARE = with_sql(MC, POINTS, HOURS) + f"SELECT {r('sum(messages) FILTER (WHERE hour >= 22 OR hour < 6) / sum(messages)')} AS night_share, arg_min(hour, (-messages, hour)) AS peak_hour FROM hours"


def modal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.modal_band(V.hour_histogram(_period(spark, sf_dir)))


MODAL_BAND = with_sql(MC, POINTS, HOURS) + f""", b AS (SELECT a.hour AS start, sum(o.messages)::BIGINT AS n FROM hours a JOIN hours o ON (o.hour - a.hour + 24) % 24 < 3 GROUP BY 1)
SELECT arg_min(start, (-n, start)) AS band_start, max(n) AS band_messages, {r("max(n) * 3 / sum(n)")} AS band_share FROM b"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.archive(spark, sf_dir)
    return rows.where(within(F.col("published_at"), P.previous_start, P.end) & F.col("decision").isin(*A.ASSERTING))


def period_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir)
    return V.period_dimensions(_both(spark, sf_dir), F.col("published_at") >= instant(P.start), H.rollup(places, H.closure(places)), B.bridge(spark, sf_dir))


COUNTS = "count(*) FILTER (WHERE now) AS messages, count(*) FILTER (WHERE now AND created_event) AS events, count(*) FILTER (WHERE NOT now) AS previous_messages, count(*) FILTER (WHERE NOT now AND created_event) AS previous_events"
DIMENSIONS = f"""b AS (SELECT *, published_at >= TIMESTAMP '{P.start}' AS now FROM mc WHERE {span("published_at", P.previous_start, P.end)} AND decision IN {ASSERTING}
), cls AS (SELECT now, created_event, unnest({CLASSES}) AS c FROM b
), plc AS (SELECT DISTINCT b.id, b.now, b.created_event, g.region_id FROM b JOIN br ON br.classification_id = b.id AND br.role = 'asserted' JOIN reg g USING (location_id) WHERE g.region_id IS NOT NULL
), dims AS (
  SELECT 'total' AS dimension, 'all' AS key, {COUNTS} FROM b
  UNION ALL SELECT 'class', c, {COUNTS} FROM cls GROUP BY c
  UNION ALL SELECT 'region', region_id, {COUNTS} FROM plc GROUP BY region_id
  UNION ALL SELECT 'hour', lpad({LOCAL_HOUR}::VARCHAR, 2, '0') AS h, {COUNTS} FROM b GROUP BY h
  UNION ALL SELECT 'version', classifier_version, {COUNTS} FROM b GROUP BY classifier_version
  UNION ALL SELECT 'direction', lower(left(trim(direction_text), 80)) AS d, {COUNTS} FROM b WHERE direction_text IS NOT NULL GROUP BY d
)"""
PERIOD_DIMENSIONS = with_sql(MC, BR, LOC, REG, DIMENSIONS) + "SELECT * FROM dims"


def composed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.composed(period_dimensions(spark, sf_dir), "class")


COMPOSED = with_sql(MC, BR, LOC, REG, DIMENSIONS) + f"""
SELECT key, messages, previous_messages, {r("messages / sum(messages) OVER ()")} AS share,
  CASE WHEN previous_messages = 0 AND messages > 0 THEN 'new' WHEN previous_messages = 0 THEN 'steady' WHEN (messages - previous_messages) / previous_messages > 0.15 THEN 'up'
    WHEN (messages - previous_messages) / previous_messages < -0.15 THEN 'down' ELSE 'steady' END AS trend,
  CASE WHEN previous_messages > 0 THEN {r("(messages - previous_messages) / previous_messages * 100", 1)} END AS delta_percent
FROM dims WHERE dimension = 'class'"""


# --- tactics: the sample of two windows, then one query for each detector


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.archive(spark, sf_dir).where(within(F.col("published_at"), TW.baseline_start, TW.current_end) & F.col("decision").isin(*A.ASSERTING))
    return rows.withColumn("now", F.col("published_at") >= instant(TW.current_start))


def _by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.when(F.col("now"), 1)).alias("current"), F.count(F.when(~F.col("now"), 1)).alias("baseline"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class 'artillery' is left out of most of the baseline and 'uav' of most of the day, so that mixes differ."""
    rows = _sample(spark, sf_dir).select("now", F.explode(A.mentioned_classes()).alias("threat_type"))
    return _by(rows, "threat_type").select("threat_type", F.when(F.col("threat_type") == "uav", F.floor(F.col("current") / 9)).otherwise(F.col("current")).alias("current"), F.when(F.col("threat_type") == "artillery", F.lit(0)).otherwise(F.col("baseline")).alias("baseline"))


SAMPLE = f"b AS (SELECT *, published_at >= TIMESTAMP '{TW.current_start}' AS now FROM mc WHERE {span('published_at', TW.baseline_start, TW.current_end)} AND decision IN {ASSERTING})"
TWO = "count(*) FILTER (WHERE now) AS current, count(*) FILTER (WHERE NOT now) AS baseline"
CLASS_ROWS = f"""u AS (SELECT now, unnest({CLASSES}) AS threat_type FROM b), u2 AS (SELECT threat_type, {TWO} FROM u GROUP BY 1), cr AS (
  SELECT threat_type, CASE WHEN threat_type = 'uav' THEN current // 9 ELSE current END AS current, CASE WHEN threat_type = 'artillery' THEN 0 ELSE baseline END AS baseline FROM u2
), shares AS (SELECT *, current / sum(current) OVER () AS cs, baseline / sum(baseline) OVER () AS bs FROM cr)"""


def _found(code: str, subject: str, effect: str, source: str, where: str, most: int | None) -> str:
    limit = f" ORDER BY abs(effect) DESC, current DESC, subject LIMIT {most}" if most else ""
    return f"SELECT '{code}' AS code, {subject} AS subject, current::DOUBLE AS current, baseline::DOUBLE AS baseline, {r(effect)} AS effect FROM {source} WHERE {where}{limit}"


def mix_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.weapon_mix_shift(_classes(spark, sf_dir))


MIX_SHIFT = with_sql(MC, SAMPLE, CLASS_ROWS) + _found("weapon_mix_shift", "threat_type", "cs - bs", "shares", "greatest(current, baseline) >= 5 AND abs(cs - bs) >= 0.15", 4)


def new_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.new_weapon_class(_classes(spark, sf_dir))


NEW_CLASS = with_sql(MC, SAMPLE, CLASS_ROWS) + _found("new_weapon_class", "threat_type", "current", "shares", "baseline = 0 AND current >= 5", 3)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By region; regions n0 to n4 have no baseline, and n7 has all of its own twentyfold now."""
    places = B.locations(spark, sf_dir)
    placed = B.bridge(spark, sf_dir).where("role = 'asserted'").join(H.rollup(places, H.closure(places)), "location_id").select(F.col("classification_id").alias("id"), "region_id").distinct()
    rows = _by(_sample(spark, sf_dir).select("id", "now").join(placed, "id"), "region_id")
    return rows.select("region_id", F.when(F.col("region_id") == "n7", F.col("current") * 20).otherwise(F.col("current")).alias("current"), F.when(F.col("region_id").isin("n0", "n1", "n2", "n3", "n4"), F.lit(0)).otherwise(F.col("baseline")).alias("baseline"))


REGION_ROWS = f"""pl AS (SELECT DISTINCT b.id, b.now, g.region_id FROM b JOIN br ON br.classification_id = b.id AND br.role = 'asserted' JOIN reg g USING (location_id)), r0 AS (SELECT region_id, {TWO} FROM pl GROUP BY 1), rr AS (
  SELECT region_id, CASE WHEN region_id = 'n7' THEN current * 20 ELSE current END AS current, CASE WHEN region_id IN ('n0', 'n1', 'n2', 'n3', 'n4') THEN 0 ELSE baseline END AS baseline FROM r0
), rshares AS (SELECT *, current / sum(current) OVER () AS cs, baseline / sum(baseline) OVER () AS bs FROM rr), top AS (SELECT * FROM rshares ORDER BY current DESC, region_id LIMIT 1)"""


def territory_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.territory_expansion(_regions(spark, sf_dir))


EXPANSION = with_sql(MC, BR, LOC, REG, SAMPLE, REGION_ROWS) + _found("territory_expansion", "region_id", "current", "rr", "baseline = 0 AND current >= 3", 3)


def territory_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.territory_concentration(_regions(spark, sf_dir))


CONCENTRATION = with_sql(MC, BR, LOC, REG, SAMPLE, REGION_ROWS) + _found("territory_concentration", "region_id", "cs - bs", "top", "current >= 5 AND abs(cs - bs) >= 0.2", None)


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour of the day; of the day, messages from 22 o'clock to 6 are counted fivefold, so that the night's share moves."""
    rows = _by(_sample(spark, sf_dir).withColumn("hour", F.hour(F.from_utc_timestamp("published_at", "Europe/Kyiv"))), "hour")
    return rows.select("hour", F.when((F.col("hour") >= 22) | (F.col("hour") < 6), F.col("current") * 5).otherwise(F.col("current")).alias("current"), "baseline")


def launch_hour_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.launch_hour_shift(_hours(spark, sf_dir))


LAUNCH_HOURS = with_sql(MC, SAMPLE) + f""", h0 AS (SELECT {LOCAL_HOUR} AS hour, {TWO} FROM b GROUP BY 1), h AS (SELECT hour, CASE WHEN hour >= 22 OR hour < 6 THEN current * 5 ELSE current END AS current, baseline FROM h0
), night AS (SELECT sum(current) FILTER (WHERE hour >= 22 OR hour < 6) / sum(current) AS c, sum(baseline) FILTER (WHERE hour >= 22 OR hour < 6) / sum(baseline) AS b FROM h
), starts AS (SELECT s.start, coalesce(sum(current), 0) AS current, coalesce(sum(baseline), 0) AS baseline FROM range(24) s(start) LEFT JOIN h ON (h.hour - s.start + 24) % 24 < 3 GROUP BY 1
), band AS (SELECT arg_min(start, (-current, start)) AS c, arg_min(start, (-baseline, start)) AS b, max(current) / (SELECT sum(current) FROM h) AS cs, max(baseline) / (SELECT sum(baseline) FROM h) AS bs FROM starts)
SELECT 'launch_hour_shift' AS code, 'night' AS subject, c::DOUBLE AS current, b::DOUBLE AS baseline, {r("c - b")} AS effect FROM night WHERE abs(c - b) >= 0.2
UNION ALL SELECT 'launch_hour_shift', 'band', c::DOUBLE, b::DOUBLE, {r("least(abs(c - b), 24 - abs(c - b))")} FROM band WHERE least(abs(c - b), 24 - abs(c - b)) >= 3 AND least(cs, bs) >= 0.25"""


def _waves_of(rows: DataFrame, now: bool) -> DataFrame:
    """Split at the start of a bucket, then waves on either side."""
    points = V.timeline(rows, 10, BY)
    side = F.col("at") >= instant(TW.current_start)
    return V.waves(points.where(side if now else ~side), keys=BY)


def wave_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of all sources."""
    rows = _sample(spark, sf_dir)
    return T.wave_cadence_change(_waves_of(rows, True), _waves_of(rows, False))


CADENCE = with_sql(MC, SAMPLE) + f""", m AS (SELECT source_id, time_bucket(INTERVAL '10 minutes', published_at, TIMESTAMP '2000-01-01') AS slot, min(published_at) AS f, max(published_at) AS l, count(*) AS n FROM b GROUP BY ALL
), g AS (SELECT *, slot >= TIMESTAMP '{TW.current_start}' AS now FROM m), s AS (SELECT *, coalesce(epoch(f) - epoch(lag(l) OVER (PARTITION BY source_id, now ORDER BY slot)) > 5400, true)::INT AS begins FROM g
), k AS (SELECT *, sum(begins) OVER (PARTITION BY source_id, now ORDER BY slot) AS wave FROM s), w AS (SELECT source_id, now, wave, {r("epoch(max(l)) - epoch(min(f))", 1)} AS seconds FROM k GROUP BY ALL HAVING sum(n) >= 2
), e AS (SELECT count(*) FILTER (WHERE now) AS cn, count(*) FILTER (WHERE NOT now) AS bn, quantile_cont(seconds, 0.5) FILTER (WHERE now) AS cm, quantile_cont(seconds, 0.5) FILTER (WHERE NOT now) AS bm FROM w)
SELECT 'wave_cadence_change' AS code, 'duration' AS subject, cm::DOUBLE AS current, bm::DOUBLE AS baseline, {r("(cm - bm) / bm")} AS effect FROM e WHERE cn >= 3 AND bn >= 3 AND bm > 0 AND abs((cm - bm) / bm) >= 0.4
UNION ALL SELECT 'wave_cadence_change', 'frequency', cn::DOUBLE, bn / 14, {r("cn - bn / 14")} FROM e WHERE cn + bn > 0 AND abs(cn - bn / 14) >= 1"""


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir)
    return T.corridors(_sample(spark, sf_dir), B.bridge(spark, sf_dir), H.rollup(places, H.closure(places)))


CORRIDOR_ROWS = f"""side AS (SELECT DISTINCT classification_id AS id, role, region_id FROM br JOIN reg USING (location_id)), cor AS (
  SELECT a.region_id AS from_id, z.region_id AS to_id, {TWO} FROM b JOIN side a ON a.id = b.id AND a.role = 'retracted' JOIN side z ON z.id = b.id AND z.role = 'asserted' WHERE a.region_id <> z.region_id GROUP BY ALL
)"""
CORRIDORS = with_sql(MC, BR, LOC, REG, SAMPLE, CORRIDOR_ROWS) + "SELECT * FROM cor"


def redirect_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the day's messages, each counted four times."""
    return T.redirect_corridor(corridors(spark, sf_dir).withColumn("current", F.col("current") * 4))


REDIRECTS = with_sql(MC, BR, LOC, REG, SAMPLE, CORRIDOR_ROWS) + _found("redirect_corridor", "from_id || '>' || to_id", "current - baseline / 14", "(SELECT from_id, to_id, current * 4 AS current, baseline FROM cor)", "current >= 3 AND baseline / 14 <= current / 2", 3)


def tactics_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, regions = _classes(spark, sf_dir), _regions(spark, sf_dir)
    found = T.weapon_mix_shift(classes).unionByName(T.new_weapon_class(classes)).unionByName(T.territory_expansion(regions)).unionByName(T.territory_concentration(regions))
    return T.merged(found, 100, 1000)


def _tactics_sql() -> str:
    found = " UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in (_found("weapon_mix_shift", "threat_type", "cs - bs", "shares", "greatest(current, baseline) >= 5 AND abs(cs - bs) >= 0.15", 4), _found("new_weapon_class", "threat_type", "current", "shares", "baseline = 0 AND current >= 5", 3), _found("territory_expansion", "region_id", "current", "rr", "baseline = 0 AND current >= 3", 3), _found("territory_concentration", "region_id", "cs - bs", "top", "current >= 5 AND abs(cs - bs) >= 0.2", None)))
    order = "list_position(['new_weapon_class', 'weapon_mix_shift', 'launch_hour_shift', 'territory_expansion', 'territory_concentration', 'wave_cadence_change', 'redirect_corridor'], code)"
    return with_sql(MC, BR, LOC, REG, SAMPLE, CLASS_ROWS, REGION_ROWS) + f"SELECT *, row_number() OVER (ORDER BY {order}, abs(effect) DESC, subject)::INT AS rank FROM ({found})"


# --- trust and risk


def trust_assertion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.assertion_metrics(B.assertions(spark, sf_dir), TRUST_AS_OF, days=400, half=60.0)
    return rows.withColumns({c: _r(c) for c in ("withdrawn_share", "corroborated_share")})


def _r(c: str):
    return rounded(F.col(c))


def _age(column: str, as_of: datetime) -> str:
    return f"pow(0.5, greatest(epoch(TIMESTAMP '{as_of}') - epoch({column}), 0) / 86400"


TRUST_ASSERTIONS = f"""am AS (
  SELECT source_id, count(*) AS sample_size, coalesce(sum(w) FILTER (WHERE withdrawn), 0) / sum(w) AS withdrawn_share, coalesce(sum(w) FILTER (WHERE groups > 1), 0) / sum(w) AS corroborated_share
  FROM (SELECT p.*, g.groups, {_age("p.at", TRUST_AS_OF)} / 60.0) AS w FROM (
    SELECT source_id, event_id, independence_group, min(asserted_at) AS at, bool_or(withdrawn_at IS NOT NULL) AS withdrawn FROM ta WHERE asserted_at >= TIMESTAMP '{TRUST_AS_OF}' - INTERVAL '400 days' GROUP BY ALL
  ) p JOIN (SELECT event_id, count(DISTINCT independence_group) AS groups FROM ta WHERE asserted_at >= TIMESTAMP '{TRUST_AS_OF}' - INTERVAL '400 days' GROUP BY 1) g USING (event_id)) GROUP BY 1
)"""
TRUST_ASSERTION_METRICS = with_sql(TA, TRUST_ASSERTIONS) + f"SELECT source_id, sample_size, {r('withdrawn_share')} AS withdrawn_share, {r('corroborated_share')} AS corroborated_share FROM am"


def trust_message_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.message_metrics(B.archive(spark, sf_dir), B.sources(spark, sf_dir), AS_OF)
    return rows.withColumns({c: _r(c) for c in ("unreadable_share", "lag_median_seconds")})


TRUST_MESSAGES = f"""mb AS (
  SELECT m.*, coalesce(s.independence_group, m.source_id) AS g, {_age("published_at", AS_OF)} / 10.0) AS w FROM mc m LEFT JOIN src s ON s.id = m.source_id WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30 days'
), gf AS (SELECT event_id, g, min((published_at, source_id)) AS f FROM mb WHERE event_id IS NOT NULL GROUP BY ALL), el AS (SELECT event_id, min(f) AS l FROM gf GROUP BY 1
), mm AS (
  SELECT source_id, unreadable_share, coalesce(first_reports, 0) AS first_reports, lag_median_seconds
  FROM (SELECT source_id, coalesce(sum(w) FILTER (WHERE decision IN ('ignored', 'unrecognized')), 0) / sum(w) AS unreadable_share FROM mb GROUP BY 1)
  LEFT JOIN (SELECT l[2] AS source_id, count(*) AS first_reports FROM el GROUP BY 1) USING (source_id)
  LEFT JOIN (SELECT f[2] AS source_id, quantile_cont(epoch(f[1]) - epoch(l[1]), 0.5) AS lag_median_seconds FROM gf JOIN el USING (event_id) WHERE f[1] > l[1] GROUP BY 1) USING (source_id)
)"""
TRUST_MESSAGE_METRICS = with_sql(MC, SRC, TRUST_MESSAGES) + f"SELECT source_id, {r('unreadable_share')} AS unreadable_share, first_reports, {r('lag_median_seconds')} AS lag_median_seconds FROM mm"


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.assertion_metrics(B.assertions(spark, sf_dir), TRUST_AS_OF, days=400, half=60.0)
    m = S.message_metrics(B.archive(spark, sf_dir), B.sources(spark, sf_dir), AS_OF)
    named = B.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "official")
    scored = S.trust_score(named.join(a, "source_id", "left").join(m, "source_id", "left"))
    return scored.select("source_id", "trust", "neutral", F.coalesce("official_floor_applied", F.lit(False)).alias("official_floor_applied"), S.trust_modifier(F.col("trust")).alias("modifier"), S.trust_label(F.col("trust")).alias("label"))


TRUST_SCORE = with_sql(MC, SRC, TA, TRUST_ASSERTIONS, TRUST_MESSAGES) + f""", x AS (
  SELECT s.id AS source_id, official, coalesce(sample_size, 0) AS n, coalesce(first_reports, 0) AS led, lag_median_seconds, {r("coalesce(withdrawn_share, 0)")} AS ws, {r("coalesce(corroborated_share, 0)")} AS co, {r("coalesce(unreadable_share, 0)")} AS un
  FROM src s LEFT JOIN am ON am.source_id = s.id LEFT JOIN mm ON mm.source_id = s.id
), y AS (
  SELECT *, n < 20 AS neutral, 0.35 * (1 - ws) + 0.25 * co + 0.15 * least(led / nullif(n, 0), 1) + 0.10 * CASE WHEN lag_median_seconds IS NULL THEN 0.5 ELSE least(greatest(1 - {r("greatest(lag_median_seconds, 0)", 1)} / 1800.0, 0), 1) END + 0.15 * (1 - un) AS measured FROM x
), z AS (SELECT *, CASE WHEN neutral THEN 0.5 ELSE {r("CASE WHEN official THEN greatest(measured, 0.5) ELSE measured END", 3)} END AS trust FROM y)
SELECT source_id, trust, neutral, coalesce(NOT neutral AND official AND measured < 0.5, false) AS official_floor_applied,
  {r("CASE WHEN trust <= 0.5 THEN 0.6 + 0.4 * trust / 0.5 ELSE 1 + 0.2 * (trust - 0.5) / 0.5 END")} AS modifier, CASE WHEN trust >= 0.65 THEN 'high' WHEN trust <= 0.4 THEN 'reduced' ELSE 'usual' END AS label FROM z"""


def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as signals: tier by user, group by user, place by event, contribution by value."""
    e = B.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    tier = B.pick(("A", "B", "C", "C", "C"), F.col("user_id"))
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        B.pick(("explicit_threat", "mentioned", "official_alert", "reported_direction"), F.col("k")).alias("signal_type"),
        F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")).alias("location_id"),
        F.coalesce(B.pick(B.CLASSES, F.col("k")), F.lit("unknown")).alias("threat_type"),
        tier.alias("source_tier"),
        F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")).alias("independence_group"),
        F.coalesce(*(F.when(tier == t, F.lit(x)) for t, x in R.RELIABILITY.items())).alias("reliability"),
        (F.col("value") / 200).alias("contribution"),
        F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 11) / 10).alias("source_trust"),
        F.col("ts").alias("observed_at"),
        F.timestamp_micros(F.unix_micros("ts") + 72 * 3_600_000_000).alias("expires_at"),
    )


SIGNALS = f"""sg AS (
  SELECT event_id::VARCHAR AS id, ['explicit_threat', 'mentioned', 'official_alert', 'reported_direction'][k % 4 + 1] AS signal_type, 'n' || (event_id % 25) AS location_id,
    coalesce(['uav', 'ballistic_missile', 'cruise_missile', 'guided_air_bomb', NULL, 'artillery'][k % 6 + 1], 'unknown') AS threat_type, ['A', 'B', 'C', 'C', 'C'][user_id % 5 + 1] AS source_tier,
    'g' || (user_id % 10) AS independence_group, [1.0, 0.75, 0.4, 0.4, 0.4][user_id % 5 + 1]::DOUBLE AS reliability, value / 200 AS contribution,
    CASE WHEN user_id % 4 <> 0 THEN (user_id % 11) / 10 END AS t, ts AS observed_at, ts + INTERVAL '72 hours' AS expires_at
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
), ef AS (
  SELECT *, contribution * reliability * pow(2, -greatest(epoch(TIMESTAMP '{AS_OF}') - epoch(observed_at), 0) / 3600 / 2) *
    CASE WHEN t IS NULL THEN 1 WHEN t <= 0.5 THEN {r("0.6 + 0.4 * (t / 0.5)")} ELSE {r("1 + 0.2 * ((t - 0.5) / 0.5)")} END AS e FROM sg WHERE expires_at > TIMESTAMP '{AS_OF}'
)"""


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.effective(R.live(risk_signals(spark, sf_dir), AS_OF), AS_OF)


def risk_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir).select("id", "location_id", "threat_type", _r("effective_contribution").alias("effective_contribution"))


RISK_EFFECTIVE = with_sql(SIGNALS) + f"SELECT id, location_id, threat_type, {r('e')} AS effective_contribution FROM ef"


def risk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assessments(_effective(spark, sf_dir)).withColumn("score", _r("score"))


ASSESSED = """asd AS (
  SELECT location_id, threat_type, count(*) AS signals, least(sum(e), 10) AS score, count(DISTINCT independence_group) AS groups, bool_or(source_tier = 'A') AS has_a, bool_and(source_tier = 'C') AS only_c FROM ef GROUP BY ALL
), ty0 AS (SELECT location_id, threat_type, signal_type, sum(e) AS e FROM ef GROUP BY ALL
), ty AS (SELECT *, row_number() OVER (PARTITION BY location_id, threat_type ORDER BY e DESC, signal_type) AS n FROM ty0
), tops AS (SELECT location_id, threat_type, string_agg(signal_type, ',' ORDER BY n) AS top_signals FROM ty WHERE n <= 3 GROUP BY ALL)"""
RISK_FALLBACK = with_sql(SIGNALS, ASSESSED) + f"SELECT location_id, threat_type, signals, {r('score')} AS score, groups, has_a, only_c, CASE WHEN groups >= 2 THEN 'medium' ELSE 'low' END AS confidence, top_signals FROM asd JOIN tops USING (location_id, threat_type)"


def risk_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir)
    return rows.select("location_id", "threat_type", _r("score").alias("score"), "confidence", "level")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores times 40, so that ceilings and levels are reached."""
    rows = R.assessments(_effective(spark, sf_dir))
    return R.guarded(rows.withColumn("score", F.least(F.col("score") * 40, F.lit(10.0))))


GUARDED = """gd AS (
  SELECT location_id, threat_type, has_a, least(least(score * 40, 10), CASE WHEN only_c THEN 3.9 WHEN NOT has_a THEN 5.9 ELSE 10 END) AS score, CASE WHEN only_c OR groups < 2 THEN 'low' ELSE 'medium' END AS confidence FROM asd
), lv AS (SELECT *, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'elevated' WHEN score >= 2 THEN 'guarded' ELSE 'low' END AS level FROM gd)"""
RISK_GUARDRAILS = with_sql(SIGNALS, ASSESSED, GUARDED) + f"SELECT location_id, threat_type, {r('score')} AS score, confidence, level FROM lv"


def risk_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against made-up previous rows: 2.1 in odd places, generated two hours before."""
    rows = _scaled(spark, sf_dir)
    odd = F.substring("location_id", 2, 9).cast("int") % 2 == 1
    previous = rows.where(odd).select("location_id", "threat_type", F.lit(2.1).alias("score"), F.lit("guarded").alias("level"), F.lit("m").alias("model_version"), F.lit(datetime(2024, 1, 29, 22)).cast("timestamp").alias("generated_at"), F.lit(datetime(2024, 1, 30, 4)).cast("timestamp").alias("expires_at"))
    return R.publication(rows, previous, AS_OF, "m").select("location_id", "threat_type", "action")


RISK_PUBLICATION = with_sql(SIGNALS, ASSESSED, GUARDED) + """
SELECT location_id, threat_type, CASE WHEN substr(location_id, 2)::INT % 2 = 0 THEN 'publish' WHEN abs(score - 2.1) > 3 AND NOT has_a THEN 'reject' WHEN level = 'guarded' AND abs(score - 2.1) < 0.5 THEN 'extend' ELSE 'publish' END AS action FROM lv"""


def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.assertions(spark, sf_dir).select(F.col("asserted_at").alias("started_at"), F.col("withdrawn_at").alias("ended_at"), F.col("threat_type").alias("location_id"))
    return V.monthly_rollup(rows)


MONTHLY = with_sql(TA) + f""", p AS (SELECT strftime(date_trunc('month', asserted_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv'), '%Y-%m-%d') AS month, threat_type AS location_id, epoch(withdrawn_at) - epoch(asserted_at) AS s FROM ta WHERE withdrawn_at IS NOT NULL)
SELECT month, location_id, count(*) AS periods, {r("sum(s)", 1)} AS total_seconds, {r("avg(s)", 1)} AS mean_seconds, {r("max(s)", 1)} AS longest_seconds FROM p GROUP BY ALL"""

QUERIES = {
    "timeline_buckets": (timeline_buckets, TIMELINE),
    "waves": (waves, WAVES),
    "repeated_pairs": (repeated_pairs, REPEATED_PAIRS),
    "hour_histogram": (hour_histogram, HOUR_HISTOGRAM),
    "night_share": (night_share, NIGHT_SHARE),
    "modal_band": (modal_band, MODAL_BAND),
    "period_dimensions": (period_dimensions, PERIOD_DIMENSIONS),
    "composed_classes": (composed_classes, COMPOSED),
    "mix_shift": (mix_shift, MIX_SHIFT),
    "new_class": (new_class, NEW_CLASS),
    "territory_expansion": (territory_expansion, EXPANSION),
    "territory_concentration": (territory_concentration, CONCENTRATION),
    "launch_hour_shift": (launch_hour_shift, LAUNCH_HOURS),
    "wave_cadence": (wave_cadence, CADENCE),
    "corridors": (corridors, CORRIDORS),
    "redirect_corridors": (redirect_corridors, REDIRECTS),
    "tactics_ranked": (tactics_digest, _tactics_sql()),
    "trust_assertion_metrics": (trust_assertion_metrics, TRUST_ASSERTION_METRICS),
    "trust_message_metrics": (trust_message_metrics, TRUST_MESSAGE_METRICS),
    "trust_score": (trust_score, TRUST_SCORE),
    "risk_effective": (risk_effective, RISK_EFFECTIVE),
    "risk_fallback": (risk_fallback, RISK_FALLBACK),
    "risk_guardrails": (risk_guardrails, RISK_GUARDRAILS),
    "risk_publication": (risk_publication, RISK_PUBLICATION),
    "monthly_rollup": (monthly_rollup, MONTHLY),
}
