"""States of territories over the driver's tables: suppliers' places are districts here, so that their regions are covered in
part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeops import text as stamped
from ..operators import hierarchy as H, territories as T
from . import binding as B
from .binding import LOCATIONS_SQL as LOC, TREE_SQL as TREE


def composed_territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = B.locations(spark, sf_dir).withColumn("type", F.when(F.col("type") == "hromada", "raion").otherwise(F.col("type")))
    e = B.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    place = F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), (F.col("user_id") % 140 + 1).cast("string"))).when(F.col("k") % 3 == 1, F.concat(F.lit("s"), (F.col("user_id") % 9 + 1).cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")))
    rows = e.withColumn("location_id", place)
    alerts = rows.where("event_id % 11 = 0").select(F.col("event_id").alias("id"), "location_id", F.col("ts").alias("started_at"))
    threats = rows.where("event_id % 5 < 3").select(
        F.floor(F.col("event_id") / 3).alias("event_id"), "location_id", B.pick(("uav", "mlrs", "aviation"), F.floor(F.col("event_id") / 3)).alias("threat_type"), B.pick(("mentioned", "aftermath", "reported_direction", "explicit_threat"), F.col("k")).alias("relation"),
        B.pick(("unverified", "monitoring", "confirmed", "official"), F.floor(F.col("event_id") / 3)).alias("evidence"), B.pick(("now", None, "evening", "within_hour"), F.floor(F.col("event_id") / 3)).alias("timing"), (F.floor(F.col("event_id") / 3) % 10 / 10.0).alias("probability"),
    )
    assessments = rows.where("event_id % 13 = 0").select(F.col("event_id").alias("id"), "location_id", B.pick(("uav", "mlrs"), F.col("k")).alias("threat_type"), B.pick(T.LEVELS, F.col("k")).alias("risk_level"), (F.col("user_id") % 6).alias("risk_score"))
    out = T.composed_states(places, H.closure(places), alerts, threats, assessments)
    classes = F.array_join(F.transform("threats", lambda x: F.concat_ws(":", x["threat_type"], x["relation"], x["evidence"], x["coverage"], x["events"].cast("string"), x["asserted"].cast("string"), x["consequence"].cast("string"))), ",")
    return out.select("territory_id", "coverage", "alerts", stamped(F.col("alert_since")).alias("alert_since"), classes.alias("threats"), "threat_active", "consequences", F.array_join("expected", ",").alias("expected"), "assessment_id", "threat_type", "risk_level", "analytic")


COMPOSED = f"""WITH {LOC}, {TREE}, kinds AS (SELECT id, CASE type WHEN 'hromada' THEN 'raion' ELSE type END AS type FROM loc),
reach AS (SELECT descendant_id AS place, ancestor_id AS territory_id, CASE WHEN depth = 0 THEN 3 WHEN depth = min(depth) OVER (PARTITION BY descendant_id) THEN 2 ELSE 1 END AS c
  FROM tree JOIN kinds a ON a.id = ancestor_id JOIN kinds d ON d.id = descendant_id WHERE a.type IN ('oblast', 'raion') AND d.type <> 'country'),
ev AS (SELECT *, event_id // 3 AS e, CASE k % 3 WHEN 0 THEN 'c' || (user_id % 140 + 1) WHEN 1 THEN 's' || (user_id % 9 + 1) ELSE 'n' || (event_id % 25) END AS place FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
al AS (SELECT territory_id, max(c) AS c, count(*) AS alerts, min(ts) AS since FROM ev JOIN reach USING (place) WHERE event_id % 11 = 0 GROUP BY 1),
th AS (SELECT territory_id, c, e, ['uav', 'mlrs', 'aviation'][e % 3 + 1] AS kind, k % 4 + 1 AS r, e % 4 + 1 AS v, ['now', NULL, 'evening', 'within_hour'][e % 4 + 1] AS timing, e % 10 AS p FROM ev JOIN reach USING (place) WHERE event_id % 5 < 3),
cl AS (SELECT territory_id, kind, max(c) AS c, max(r) AS r, max(v) AS v, count(DISTINCT e) AS n, bool_or(r = 2 AND v >= 3) AS hit FROM th WHERE timing IS NULL OR timing = 'now' GROUP BY ALL),
tt AS (SELECT territory_id, max(c) AS c, string_agg(concat_ws(':', kind, ['mentioned', 'aftermath', 'reported_direction', 'explicit_threat'][r], ['unverified', 'monitoring', 'confirmed', 'official'][v], ['partial', 'unmapped', 'direct'][c], n, r > 1, hit), ',' ORDER BY kind) AS threats,
  bool_or(r > 1) AS active, bool_or(hit) AS hits FROM cl GROUP BY 1),
ex AS (SELECT territory_id, e, max(c) AS c, min(CASE timing WHEN 'within_hour' THEN 1 ELSE 2 END) AS t, max(p) AS p FROM th WHERE timing <> 'now' GROUP BY ALL),
el AS (SELECT territory_id, max(c) AS c, array_to_string(list(e ORDER BY t, p DESC, e)[1:6], ',') AS expected FROM ex GROUP BY 1),
se AS (SELECT territory_id, max(c) OVER (PARTITION BY territory_id) AS c, event_id AS id, ['uav', 'mlrs'][k % 2 + 1] AS kind, ['background', 'elevated', 'significant', 'high', 'very_high'][k % 5 + 1] AS level,
  row_number() OVER (PARTITION BY territory_id ORDER BY user_id % 6 DESC, k % 5 DESC, event_id) AS place_no FROM ev JOIN reach USING (place) WHERE event_id % 13 = 0),
sa AS (SELECT * FROM se WHERE place_no = 1)
SELECT territory_id, ['partial', 'unmapped', 'direct'][greatest(al.c, tt.c, el.c, sa.c)] AS coverage, coalesce(alerts, 0) AS alerts, strftime(since, '%Y-%m-%d %H:%M:%S') AS alert_since, coalesce(threats, '') AS threats,
  coalesce(active, false) AS threat_active, coalesce(hits, false) AS consequences, coalesce(expected, '') AS expected, id AS assessment_id, kind AS threat_type, level AS risk_level, CASE WHEN level <> 'background' THEN level ELSE 'none' END AS analytic
FROM al FULL JOIN tt USING (territory_id) FULL JOIN el USING (territory_id) FULL JOIN sa USING (territory_id)"""

QUERIES = {"composed_territories": (composed_territories, COMPOSED)}
