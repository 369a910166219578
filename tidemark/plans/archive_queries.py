"""Archive slices and the place tree over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import archive as A, hierarchy as H
from . import binding as B
from .binding import ARCHIVE_SQL as MC, ASSERTIONS_SQL as TA, BRIDGE_SQL as BR, LOCATIONS_SQL as LOC, LOSS_WINDOW as L, REGIONS_SQL as REG, SOURCES_SQL as SRC, TREE_SQL as TREE, WINDOW as W, r, span, stamp, with_sql

ASSERTING = "('event_created', 'event_merged', 'redirect')"
BUCKET = "strftime(date_trunc('day', published_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv'), '%Y-%m-%d')"
PLACED = f"""base AS (
  SELECT *, {BUCKET} AS bucket, published_at >= TIMESTAMP '{W.start}' AS is_now FROM mc
  WHERE {span("published_at", W.previous_start, W.end)} AND decision IN {ASSERTING}
), placed AS (
  SELECT DISTINCT b.id, b.classifier_version, b.bucket, b.created_event, b.event_id, coalesce(b.threat_type, 'unknown') AS threat_type, b.is_now,
    coalesce(g.region_id, CASE WHEN b.national_scope THEN 'ua' END) AS region_id
  FROM base b LEFT JOIN br ON br.classification_id = b.id AND br.role = 'asserted' LEFT JOIN reg g USING (location_id)
)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    places = B.locations(spark, sf_dir)
    tree = H.closure(places)
    return places, tree, H.rollup(places, tree)


def threat_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, _, regions = _places(spark, sf_dir)
    return A.threat_dynamics(B.archive(spark, sf_dir), B.bridge(spark, sf_dir), places, regions, W)


THREAT_DYNAMICS = with_sql(MC, BR, LOC, REG, PLACED) + f"""
SELECT 'total' AS scope, NULL::VARCHAR AS region_id, NULL::VARCHAR AS region_name, bucket, classifier_version, coalesce(threat_type, 'unknown') AS threat_type,
  count(*) AS messages, count(*) FILTER (WHERE created_event) AS events_raised, count(DISTINCT event_id) AS events
FROM base WHERE is_now GROUP BY ALL
UNION ALL
SELECT 'oblast', region_id, l.name, bucket, classifier_version, threat_type, count(*), count(*) FILTER (WHERE created_event), count(DISTINCT event_id)
FROM placed JOIN loc l ON l.id = region_id WHERE is_now GROUP BY ALL"""


def without_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.without_geography(B.archive(spark, sf_dir), B.bridge(spark, sf_dir), W)


WITHOUT_GEOGRAPHY = with_sql(MC, BR) + f"""
SELECT count(*) AS messages FROM mc WHERE {span("published_at", W.start, W.end)} AND decision IN {ASSERTING} AND NOT national_scope
  AND id NOT IN (SELECT classification_id FROM br WHERE role = 'asserted')"""


def geography_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, _, regions = _places(spark, sf_dir)
    return A.geography_shift(B.archive(spark, sf_dir), B.bridge(spark, sf_dir), places, regions, W)


GEOGRAPHY_SHIFT = with_sql(MC, BR, LOC, REG, PLACED) + f""", counted AS (
  SELECT region_id, l.name AS region_name, classifier_version, count(*) FILTER (WHERE is_now) AS current_messages,
    count(*) FILTER (WHERE is_now AND created_event) AS current_events, count(*) FILTER (WHERE NOT is_now) AS previous_messages,
    count(*) FILTER (WHERE NOT is_now AND created_event) AS previous_events
  FROM placed JOIN loc l ON l.id = region_id GROUP BY ALL
), shared AS (
  SELECT *, coalesce(current_events / nullif(sum(current_events) OVER v, 0), 0) AS cs, coalesce(previous_events / nullif(sum(previous_events) OVER v, 0), 0) AS ps,
    CASE WHEN current_events > 0 THEN row_number() OVER (PARTITION BY classifier_version ORDER BY current_events DESC, region_id) END::INT AS current_rank,
    CASE WHEN previous_events > 0 THEN row_number() OVER (PARTITION BY classifier_version ORDER BY previous_events DESC, region_id) END::INT AS previous_rank
  FROM counted WINDOW v AS (PARTITION BY classifier_version)
)
SELECT region_id, region_name, classifier_version, current_messages, current_events, previous_messages, previous_events,
  {r("cs")} AS current_share, {r("ps")} AS previous_share, current_rank, previous_rank, current_events - previous_events AS delta_events,
  {r("cs - ps")} AS delta_share, previous_rank - current_rank AS rank_delta,
  CASE WHEN previous_events = 0 AND current_events > 0 THEN 'new' WHEN current_events = 0 AND previous_events > 0 THEN 'gone'
    WHEN cs - ps > 0.02 THEN 'rising' WHEN cs - ps < -0.02 THEN 'falling' ELSE 'steady' END AS trend
FROM shared"""

VERSIONS = "versions AS (SELECT source_message_id, count(DISTINCT classifier_version) AS n, min(classifier_version) AS one FROM mc GROUP BY 1)"
LOST = f"""lost AS (
  SELECT ta.*, epoch(withdrawn_at) - epoch(asserted_at) AS held, CASE WHEN v.n = 1 THEN v.one END AS classifier_version, coalesce(g.region_id, ta.location_id) AS region
  FROM ta LEFT JOIN versions v ON v.source_message_id = ta.withdrawn_message_id LEFT JOIN reg g ON g.location_id = ta.location_id
  WHERE {span("withdrawn_at", L.start, L.end)}
)"""


def loss_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, regions = _places(spark, sf_dir)
    return A.loss_points(B.assertions(spark, sf_dir), B.archive(spark, sf_dir), regions, L)


def _loss(dimension: str, key: str, sources: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {key} AS key, classifier_version, count(*) AS withdrawals, count(DISTINCT event_id) AS events, {sources} AS sources,
  {r("quantile_cont(held, 0.5)", 1)} AS median_held_seconds, {r("quantile_cont(held, 0.9)", 1)} AS p90_held_seconds FROM lost GROUP BY {key}, classifier_version"""


LOSS_POINTS = with_sql(MC, LOC, REG, TA, VERSIONS, LOST) + " UNION ALL ".join([_loss("oblast", "region", "count(DISTINCT source_id)"), _loss("source", "source_id", "1::BIGINT"), _loss("threat_type", "threat_type", "count(DISTINCT source_id)")])


def interception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.interception(B.assertions(spark, sf_dir), B.archive(spark, sf_dir), L)


RATES = f"""rates AS (
  SELECT CASE WHEN v.n = 1 THEN v.one END AS classifier_version, count(*) AS asserted, count(withdrawn_at) AS withdrawn,
    {r("quantile_cont(epoch(withdrawn_at) - epoch(asserted_at), 0.5)", 1)} AS median_held_seconds
  FROM ta LEFT JOIN versions v ON v.source_message_id = ta.asserted_message_id WHERE {span("asserted_at", L.start, L.end)} GROUP BY 1
)"""
INTERCEPTION = with_sql(MC, TA, VERSIONS, RATES) + f"SELECT classifier_version, asserted, withdrawn, {r('withdrawn / asserted')} AS withdrawn_share, median_held_seconds FROM rates"


def interception_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.interception_overall(interception(spark, sf_dir))


INTERCEPTION_OVERALL = with_sql(MC, TA, VERSIONS, RATES) + f"""
SELECT sum(asserted)::BIGINT AS asserted, sum(withdrawn)::BIGINT AS withdrawn, {r("sum(withdrawn) / sum(asserted)")} AS withdrawn_share,
  list_sort(list(median_held_seconds) FILTER (WHERE median_held_seconds IS NOT NULL))[count(median_held_seconds) // 2 + 1] AS median_held_seconds FROM rates"""


def closed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.closed_events(B.assertions(spark, sf_dir), B.archive(spark, sf_dir), L)


CLOSED_EVENTS = with_sql(MC, TA, VERSIONS) + f""", done AS (SELECT event_id FROM ta GROUP BY 1 HAVING bool_and(withdrawn_at IS NOT NULL)), a AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY asserted_at DESC, id) AS n FROM ta SEMI JOIN done USING (event_id)
), w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY withdrawn_at DESC, id) AS n FROM ta SEMI JOIN done USING (event_id))
SELECT a.event_id, a.source_id AS last_asserted_by, a.location_id AS last_asserted_for, w.source_id AS withdrawn_by, w.location_id AS withdrawn_for, w.withdrawal_reason,
  {r("epoch(w.withdrawn_at) - epoch(a.asserted_at)", 1)} AS held_seconds, {stamp("w.withdrawn_at")} AS withdrawn_at, CASE WHEN v.n = 1 THEN v.one END AS classifier_version
FROM a JOIN w ON a.event_id = w.event_id AND a.n = 1 AND w.n = 1 LEFT JOIN versions v ON v.source_message_id = w.withdrawn_message_id
WHERE {span("w.withdrawn_at", L.start, L.end)}"""


def source_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.source_performance(B.archive(spark, sf_dir), B.sources(spark, sf_dir), W)


SOURCE_PERFORMANCE = with_sql(MC, SRC) + f""", base AS (SELECT * FROM mc WHERE {span("published_at", W.start, W.end)}), firsts AS (
  SELECT classifier_version, event_id, min(published_at) AS first_at, arg_min(source_id, (published_at, id)) AS leader FROM base WHERE event_id IS NOT NULL GROUP BY ALL
), led AS (SELECT classifier_version, leader AS source_id, count(*) AS n FROM firsts GROUP BY ALL), lag AS (
  SELECT b.classifier_version, b.source_id, b.event_id, epoch(min(b.published_at)) - epoch(any_value(f.first_at)) AS lag
  FROM base b JOIN firsts f USING (classifier_version, event_id) GROUP BY ALL
), lags AS (
  SELECT classifier_version, source_id, count(*) FILTER (WHERE lag > 0) AS follow_ups, {r("quantile_cont(lag, 0.5) FILTER (WHERE lag > 0)", 1)} AS median_lag_seconds FROM lag GROUP BY ALL
), counts AS (
  SELECT source_id, classifier_version, count(*) AS messages, count(*) FILTER (WHERE created_event) AS events_raised, count(*) FILTER (WHERE decision = 'event_merged') AS corroborations,
    count(*) FILTER (WHERE decision = 'redirect') AS redirects, count(*) FILTER (WHERE decision = 'de_escalation') AS de_escalations, count(*) FILTER (WHERE decision = 'coalesced') AS coalesced,
    count(*) FILTER (WHERE decision = 'ignored') AS ignored, count(*) FILTER (WHERE decision = 'unrecognized') AS unrecognized,
    count(*) FILTER (WHERE decision = 'de_escalation' AND withdrawn_assertions = 0) AS empty_withdrawals,
    count(*) FILTER (WHERE ignored_reason = 'no_location') AS no_location, count(*) FILTER (WHERE ignored_reason = 'not_an_assertion') AS not_an_assertion
  FROM base GROUP BY ALL
)
SELECT c.*, coalesce(s.name, c.source_id) AS name, coalesce(s.tier, '?') AS tier, coalesce(s.independence_group, '?') AS independence_group, coalesce(led.n, 0) AS first_reports,
  coalesce(follow_ups, 0) AS follow_ups, median_lag_seconds, {r("(events_raised + corroborations + redirects) / messages")} AS signal_share,
  {r("(corroborations + coalesced) / messages")} AS duplicate_share, {r("(ignored + unrecognized) / messages")} AS unreadable_share
FROM counts c LEFT JOIN src s ON s.id = c.source_id LEFT JOIN led USING (classifier_version, source_id) LEFT JOIN lags USING (classifier_version, source_id)"""

PAIRS = "pairs AS (SELECT a.decision AS a_decision, b.decision AS b_decision, a.threat_type AS a_type, b.threat_type AS b_type FROM mc a JOIN mc b USING (source_message_id) WHERE a.classifier_version = 'v1' AND b.classifier_version = 'v2')"


def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.version_comparison(B.archive(spark, sf_dir), "v1", "v2")


VERSION_COMPARISON = with_sql(MC, PAIRS) + """
SELECT count(*) AS shared, count(*) FILTER (WHERE a_decision = b_decision) AS agreed, count(*) FILTER (WHERE a_type IS DISTINCT FROM b_type) AS class_changed,
  (SELECT count(*) FROM mc WHERE classifier_version = 'v1' AND source_message_id NOT IN (SELECT source_message_id FROM mc WHERE classifier_version = 'v2')) AS only_a,
  (SELECT count(*) FROM mc WHERE classifier_version = 'v2' AND source_message_id NOT IN (SELECT source_message_id FROM mc WHERE classifier_version = 'v1')) AS only_b FROM pairs"""


def decision_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.decision_migration(B.archive(spark, sf_dir), "v1", "v2")


DECISION_MIGRATION = with_sql(MC, PAIRS) + "SELECT a_decision, b_decision, count(*) AS messages FROM pairs GROUP BY ALL"


def composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.composition_share(B.archive(spark, sf_dir), W)


COMPOSITION_SHARE = with_sql(MC) + f""", n AS (
  SELECT {BUCKET} AS bucket, classifier_version, unnest(CASE WHEN len(candidate_threat_types) > 0 THEN candidate_threat_types ELSE [coalesce(threat_type, 'unknown')] END) AS threat_type
  FROM mc WHERE {span("published_at", W.start, W.end)} AND decision IN {ASSERTING}
), c AS (SELECT bucket, classifier_version, threat_type, count(*) AS messages FROM n GROUP BY ALL)
SELECT *, {r("messages / sum(messages) OVER (PARTITION BY bucket, classifier_version)")} AS share FROM c"""


def top_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_indicators(B.archive(spark, sf_dir), W, 2)


TOP_INDICATORS = with_sql(MC) + f""", n AS (SELECT classifier_version, unnest(indicators) AS indicator FROM mc WHERE {span("published_at", W.start, W.end)})
SELECT indicator, count(*) AS messages, count(DISTINCT classifier_version) AS versions FROM n GROUP BY 1 ORDER BY messages DESC, indicator LIMIT 2"""


def archive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.archive_coverage(B.archive(spark, sf_dir))


ARCHIVE_COVERAGE = with_sql(MC) + f""", s AS (
  SELECT classifier_version, count(*) AS messages, count(DISTINCT source_id) AS sources, count(DISTINCT event_id) AS events, min(published_at) AS f, max(published_at) AS l FROM mc GROUP BY 1
)
SELECT classifier_version, messages, sources, events, {stamp("f")} AS first_at, {stamp("l")} AS last_at,
  (SELECT count(*) FROM s o WHERE o.classifier_version <> s.classifier_version AND o.f <= s.l AND s.f <= o.l) AS overlapping FROM s"""


def version_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.version_safety(B.archive(spark, sf_dir), W)


VERSION_SAFETY = with_sql(MC) + f"""
SELECT string_agg(DISTINCT classifier_version, ',' ORDER BY classifier_version) AS versions, count(DISTINCT classifier_version) <= 1 AS comparable,
  count(*) FILTER (WHERE classifier_version IS NULL) AS unattributed FROM mc WHERE {span("published_at", W.start, W.end)}"""


def rollup_nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir)[2]


ROLLUP = with_sql(LOC, REG) + "SELECT location_id, region_id FROM reg"


def related_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, tree, _ = _places(spark, sf_dir)
    return H.related(tree, places.where(F.col("type") == "oblast"))


RELATED = with_sql(LOC, TREE) + """, a AS (SELECT id FROM loc WHERE type = 'oblast')
SELECT a.id AS root_id, ancestor_id AS location_id FROM a JOIN tree ON descendant_id = a.id UNION SELECT a.id, descendant_id FROM a JOIN tree ON ancestor_id = a.id"""


def region_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, tree, _ = _places(spark, sf_dir)
    return H.ancestors_of_type(places, tree, "oblast")


REGION_ANCESTORS = with_sql(LOC, TREE) + "SELECT DISTINCT descendant_id AS location_id, ancestor_id FROM tree JOIN loc ON loc.id = ancestor_id WHERE depth > 0 AND type = 'oblast'"


def homonym_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir)
    parents = places.select(F.col("id").alias("p"), F.col("parent_id").alias("pp"), F.col("name").alias("district_name"))
    tops = places.select(F.col("id").alias("t"), F.col("name").alias("region_name"))
    short = places.where(F.col("type").isin("city", "hromada")).withColumn("name", F.concat(F.lit("place "), F.right("id", F.lit(1))))
    return H.homonym_labels(short.join(parents, F.col("parent_id") == F.col("p")).join(tops, F.col("pp") == F.col("t")))


HOMONYMS = with_sql(LOC) + """, n AS (
  SELECT c.id, 'place ' || right(c.id, 1) AS name, d.name AS district_name, t.name AS region_name FROM loc c JOIN loc d ON c.parent_id = d.id JOIN loc t ON d.parent_id = t.id WHERE c.type IN ('city', 'hromada')
)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN name WHEN count(*) OVER (PARTITION BY name, region_name) = 1 THEN name || ' (' || region_name || ')'
  ELSE name || ' (' || region_name || ', ' || district_name || ')' END AS label FROM n"""


QUERIES = {
    "threat_dynamics": (threat_dynamics, THREAT_DYNAMICS),
    "without_geography": (without_geography, WITHOUT_GEOGRAPHY),
    "geography_shift": (geography_shift, GEOGRAPHY_SHIFT),
    "loss_points": (loss_points, LOSS_POINTS),
    "interception_rate": (interception, INTERCEPTION),
    "interception_overall": (interception_overall, INTERCEPTION_OVERALL),
    "closed_events_top1": (closed_events, CLOSED_EVENTS),
    "source_performance": (source_performance, SOURCE_PERFORMANCE),
    "version_comparison": (version_comparison, VERSION_COMPARISON),
    "decision_migration": (decision_migration, DECISION_MIGRATION),
    "composition_share": (composition_share, COMPOSITION_SHARE),
    "indicator_topn": (top_indicators, TOP_INDICATORS),
    "archive_coverage": (archive_coverage, ARCHIVE_COVERAGE),
    "version_safety": (version_safety, VERSION_SAFETY),
    "rollup_nearest_ancestor": (rollup_nearest_ancestor, ROLLUP),
    "related_locations": (related_locations, RELATED),
    "region_ancestors": (region_ancestors, REGION_ANCESTORS),
    "homonym_labels": (homonym_labels, HOMONYMS),
}
