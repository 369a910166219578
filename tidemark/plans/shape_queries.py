"""Clipped layers and reported vectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import clipping as C, vectors as V
from . import binding as B


def _frame(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Rings of a rectangle with a hole, a quarter of its sides in from each side."""
    ring = lambda a, b, c, d: F.array(*(F.struct(p.cast("double").alias("x"), q.cast("double").alias("y")) for p, q in ((a, b), (c, b), (c, d), (a, d))))
    return F.array(ring(x, y, x + w, y + h), ring(x + w / 4, y + h / 4, x + w * 3 / 4, y + h * 3 / 4))


def clipped_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each customer's frame in each nation's."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    layers = B.load(spark, sf_dir, "customer").select(c.alias("layer_id"), _frame(c % 61 - 30, c % 37 - 18, c % 5 + 1, c % 3 + 1).alias("rings"))
    nations = B.load(spark, sf_dir, "nation").select(n.alias("boundary_id"), _frame(n % 5 * 12 - 30 + 0.5, F.floor(n / 5) * 8 - 20 + 0.25, F.lit(11), F.lit(7)).alias("rings"))
    return C.clipped(layers, nations).select("layer_id", "boundary_id", F.round("area", 6).alias("area"))


#: By inclusion and exclusion of rectangles and holes.
CLIPPED = """WITH a AS (SELECT c_custkey AS layer_id, c_custkey % 61 - 30 AS x, c_custkey % 37 - 18 AS y, c_custkey % 5 + 1 AS w, c_custkey % 3 + 1 AS h FROM customer),
b AS (SELECT n_nationkey AS boundary_id, n_nationkey % 5 * 12 - 29.5 AS x, n_nationkey // 5 * 8 - 19.75 AS y, 11 AS w, 7 AS h FROM nation),
ra AS (SELECT layer_id, x, y, x + w AS x2, y + h AS y2, 1 AS sign FROM a UNION ALL SELECT layer_id, x + w / 4, y + h / 4, x + w * 3 / 4, y + h * 3 / 4, -1 FROM a),
rb AS (SELECT boundary_id, x, y, x + w AS x2, y + h AS y2, 1 AS sign FROM b UNION ALL SELECT boundary_id, x + w / 4, y + h / 4, x + w * 3 / 4, y + h * 3 / 4, -1 FROM b)
SELECT layer_id, boundary_id, round(sum(ra.sign * rb.sign * greatest(least(ra.x2, rb.x2) - greatest(ra.x, rb.x), 0)::DOUBLE * greatest(least(ra.y2, rb.y2) - greatest(ra.y, rb.y), 0)::DOUBLE), 6) AS area
FROM ra CROSS JOIN rb GROUP BY ALL HAVING area > 0"""


def _vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the archive that names places, as rows of its event."""
    a = B.archive(spark, sf_dir).where(F.col("event_id").isNotNull()).select("event_id", F.col("id").alias("report_id"), F.col("published_at").alias("at"), (F.col("decision") == "redirect").alias("redirect"), "source_id", "threat_type")
    named = B.bridge(spark, sf_dir).select(F.col("classification_id").alias("report_id"), "role", "location_id", F.when(F.substring("location_id", 1, 1) == "s", "reported_direction").otherwise("mentioned").alias("relation"))
    key = F.substring("location_id", 2, 9).cast("long")
    places = B.locations(spark, sf_dir).select(F.col("id").alias("location_id"), "type")
    sources = B.sources(spark, sf_dir).select(F.col("id").alias("source_id"), "independence_group", "tier", "official")
    rows = a.join(named, "report_id").join(places, "location_id").join(sources, "source_id", "left")
    return rows.withColumn("lat", F.when(key % 4 > 0, key.cast("double"))).withColumn("lon", F.lit(30.0))


def reported_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.legs(V.positions(_vector_rows(spark, sf_dir)))
    return out.select("event_id", "report_id", F.col("offset").alias("place_no"), "from_id", "to_id", "basis", "seconds", "evidence", "independent", "drawable")


def reported_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.reported_vectors(_vector_rows(spark, sf_dir))
    return out.select("event_id", "nodes", "legs", "drawable_legs", "sources", "independence_groups", "strongest_basis", "confirmed_legs", "seconds")


_CHAIN = f"""WITH {B.ARCHIVE_SQL}, {B.BRIDGE_SQL}, {B.LOCATIONS_SQL}, {B.SOURCES_SQL}, named AS (
  SELECT mc.event_id, mc.id AS report_id, mc.published_at AS told_at, decision = 'redirect' AS redirect, role, br.location_id, loc.type, left(br.location_id, 1) = 's' AS heading,
    substr(br.location_id, 2)::BIGINT % 4 > 0 AS located, source_id, independence_group, tier, official
  FROM mc JOIN br ON mc.id = br.classification_id JOIN loc ON loc.id = br.location_id LEFT JOIN src ON src.id = mc.source_id WHERE mc.event_id IS NOT NULL
), best AS (
  SELECT event_id, report_id, CASE WHEN role = 'retracted' THEN 'passed' WHEN heading THEN 'ahead' ELSE 'anchor' END AS part, any_value(told_at) AS told_at, bool_or(redirect) AS redirect,
    arg_min(location_id, (list_position(['city', 'special_city', 'hromada', 'raion', 'oblast', 'country'], type), location_id)) AS place,
    arg_min(located, (list_position(['city', 'special_city', 'hromada', 'raion', 'oblast', 'country'], type), location_id)) AS located,
    any_value(source_id) AS source_id, any_value(independence_group) AS independence_group, any_value(tier) AS tier, any_value(official) AS official
  FROM named GROUP BY ALL
), kinds AS (
  SELECT *, bool_or(part = 'passed') OVER r AS has_passed, bool_or(part = 'ahead') OVER r AS has_ahead, bool_or(part = 'anchor') OVER r AS has_anchor FROM best WINDOW r AS (PARTITION BY event_id, report_id)
), pos AS (
  SELECT *, CASE WHEN redirect AND has_passed AND has_ahead THEN 'reported_transit' WHEN has_anchor AND has_ahead THEN 'reported_direction' ELSE 'observation_sequence' END AS basis,
    CASE WHEN redirect AND has_passed AND has_ahead THEN CASE part WHEN 'passed' THEN 0 WHEN 'ahead' THEN 1 END
      WHEN has_anchor AND has_ahead THEN CASE part WHEN 'anchor' THEN 0 WHEN 'ahead' THEN 1 END
      WHEN has_ahead THEN CASE WHEN part = 'ahead' THEN 0 END WHEN has_anchor THEN CASE WHEN part = 'anchor' THEN 0 END ELSE 0 END AS place_no FROM kinds
), chain AS (
  SELECT *, lag(place) OVER e AS from_id, lag(located) OVER e AS from_located, lag(told_at) OVER e AS from_at, lag(independence_group) OVER e AS from_group, lag(tier) OVER e AS from_tier
  FROM pos WHERE place_no IS NOT NULL WINDOW e AS (PARTITION BY event_id ORDER BY told_at, report_id, place_no)
), moved AS (
  SELECT *, place_no = 0 AND coalesce(from_group <> independence_group, false) AS apart FROM chain WHERE from_id <> place
), leg AS (
  SELECT event_id, report_id, place_no, from_id, place AS to_id, CASE WHEN place_no = 0 THEN 'observation_sequence' ELSE basis END AS basis,
    CASE WHEN place_no = 0 THEN round(date_diff('microsecond', from_at, told_at) / 1e6)::BIGINT ELSE 0 END AS seconds,
    CASE WHEN official THEN 'official' WHEN apart AND tier IN ('A', 'B') AND from_tier IN ('A', 'B') THEN 'confirmed' WHEN tier = 'B' THEN 'monitoring' ELSE 'unverified' END AS evidence,
    apart AS independent, located AND from_located AS drawable FROM moved
)
"""
LEGS = _CHAIN + "SELECT * FROM leg"
VECTORS = _CHAIN + """, own AS (SELECT event_id, count(*) AS legs, count(*) FILTER (WHERE drawable) AS drawable_legs, count(*) FILTER (WHERE evidence = 'confirmed') AS confirmed_legs,
  arg_max(basis, list_position(['observation_sequence', 'reported_direction', 'reported_transit'], basis)) AS strongest_basis FROM leg GROUP BY event_id)
SELECT p.event_id, coalesce(legs, 0) + 1 AS nodes, coalesce(legs, 0) AS legs, coalesce(drawable_legs, 0) AS drawable_legs, count(DISTINCT source_id) AS sources, count(DISTINCT independence_group) AS independence_groups,
  strongest_basis, coalesce(confirmed_legs, 0) AS confirmed_legs, date_diff('microsecond', min(told_at), max(told_at)) // 1000000 AS seconds
FROM (SELECT * FROM pos WHERE place_no IS NOT NULL) p LEFT JOIN own USING (event_id) GROUP BY p.event_id, legs, drawable_legs, confirmed_legs, strongest_basis"""

QUERIES = {"clipped_layers": (clipped_layers, CLIPPED), "reported_legs": (reported_legs, LEGS), "reported_vectors": (reported_vectors, VECTORS)}
