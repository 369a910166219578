"""The driver's tables in the roles of the archive's tables, as DataFrames and as DuckDB SQL.

events are message classifications (two versions judge each message), region, nation, customer and supplier are the
place tree, orders and lineitem are assertions and their withdrawals, suppliers are sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..params import AnalyticsWindow

DECISIONS = {"purchase": "event_created", "signup": "event_merged", "click": "ignored", "view": "de_escalation", "error": "redirect"}
CLASSES = ("uav", "ballistic_missile", "cruise_missile", "guided_air_bomb", None, "artillery")
REASONS = ("no_location", "not_an_assertion", "no_threat")
WINDOW = AnalyticsWindow.resolve(datetime(2024, 1, 30), datetime(2024, 1, 15), datetime(2024, 1, 25))
LOSS_WINDOW = AnalyticsWindow.resolve(datetime(1998, 1, 1), datetime(1997, 6, 1), datetime(1997, 12, 1))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by the keys to all tasks of a shuffle: where few bytes make much work, a number that isn't given would be
    lowered to fit the bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that a task sorts at the most, about.
ROWS_PER_TASK = 500_000


def tasks(table: DataFrame, rows: int | None = None) -> int | None:
    """How many tasks a shuffle of a table's rows needs, if more than the session has it do; the count is read from the files'
    footers. rows: of a task, if not ROWS_PER_TASK."""
    n = -(-table.count() // (rows or ROWS_PER_TASK))
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def pick(values: tuple[str | None, ...], i: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (i % len(values)).cast("int"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("k", k)
    decision = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in DECISIONS.items()))
    ignored = F.col("event_type") == "click"
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.floor(F.col("event_id") / 2).cast("string").alias("source_message_id"),
        F.concat(F.lit("v"), (F.col("event_id") % 2 + 1).cast("string")).alias("classifier_version"),
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source_id"),
        F.col("ts").alias("published_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 60_000_000).alias("classified_at"),
        decision.alias("decision"),
        (F.col("event_type") == "purchase").alias("created_event"),
        F.when(~ignored, F.concat(F.lit("e"), (F.col("k") * 40 + F.col("user_id") % 40).cast("string"))).alias("event_id"),
        pick(CLASSES, F.col("k")).alias("threat_type"),
        F.when(ignored, pick(REASONS, F.col("k"))).alias("ignored_reason"),
        (F.col("event_id") % 17 == 0).alias("national_scope"),
        (F.col("k") % 4).alias("withdrawn_assertions"),
        F.when(F.col("k") % 5 == 0, F.array(F.coalesce(pick(CLASSES, F.col("k")), F.lit("unknown")), F.lit("combined"))).otherwise(F.array().cast("array<string>")).alias("candidate_threat_types"),
        F.filter(F.array(F.when(F.col("k") % 2 == 0, F.lit("launch")), F.when(F.col("k") % 3 == 0, F.lit("carrier")), F.when(F.col("k") % 7 == 0, F.lit("track"))), lambda x: x.isNotNull()).alias("indicators"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("dir"), (F.col("k") % 4).cast("string"))).alias("direction_text"),
        F.col("value").alias("value"),
    )


ARCHIVE_SQL = """mc AS (
  SELECT event_id::VARCHAR AS id, (event_id // 2)::VARCHAR AS source_message_id, 'v' || (event_id % 2 + 1) AS classifier_version,
    's' || (user_id % 10) AS source_id, ts AS published_at, ts + to_minutes(k) AS classified_at,
    CASE event_type WHEN 'purchase' THEN 'event_created' WHEN 'signup' THEN 'event_merged' WHEN 'click' THEN 'ignored'
      WHEN 'view' THEN 'de_escalation' WHEN 'error' THEN 'redirect' END AS decision,
    event_type = 'purchase' AS created_event,
    CASE WHEN event_type <> 'click' THEN 'e' || (k * 40 + user_id % 40) END AS event_id,
    ['uav', 'ballistic_missile', 'cruise_missile', 'guided_air_bomb', NULL, 'artillery'][k % 6 + 1] AS threat_type,
    CASE WHEN event_type = 'click' THEN ['no_location', 'not_an_assertion', 'no_threat'][k % 3 + 1] END AS ignored_reason,
    event_id % 17 = 0 AS national_scope, k % 4 AS withdrawn_assertions,
    CASE WHEN k % 5 = 0 THEN [coalesce(['uav', 'ballistic_missile', 'cruise_missile', 'guided_air_bomb', NULL, 'artillery'][k % 6 + 1], 'unknown'), 'combined']
      ELSE [] END AS candidate_threat_types,
    list_filter([CASE WHEN k % 2 = 0 THEN 'launch' END, CASE WHEN k % 3 = 0 THEN 'carrier' END, CASE WHEN k % 7 = 0 THEN 'track' END], lambda x: x IS NOT NULL) AS indicators,
    CASE WHEN event_type = 'error' THEN 'dir' || (k % 4) END AS direction_text, value
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
)"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    n = F.col("event_id")
    place = lambda when, prefix, modulus, role: F.when(when, F.struct(F.concat(F.lit(prefix), (n % modulus).cast("string")).alias("location_id"), F.lit(role).alias("role")))
    places = F.array(place(n % 10 < 8, "c", 150, "asserted"), place(n % 3 == 0, "s", 10, "asserted"), place(F.col("event_type") == "error", "n", 25, "retracted"))
    return e.select(n.cast("string").alias("classification_id"), F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("classification_id", "p.*")


BRIDGE_SQL = """br AS (
  SELECT event_id::VARCHAR AS classification_id, 'c' || (event_id % 150) AS location_id, 'asserted' AS role FROM events WHERE event_id % 10 < 8
  UNION ALL SELECT event_id::VARCHAR, 's' || (event_id % 10), 'asserted' FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id::VARCHAR, 'n' || (event_id % 25), 'retracted' FROM events WHERE event_type = 'error'
)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tier(name: str, prefix: str, key: str, parent: Column, kind: str, label: str) -> DataFrame:
        return load(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), parent.cast("string").alias("parent_id"), F.lit(kind).alias("type"), F.col(label).alias("name"))

    return (
        tier("region", "r", "r_regionkey", F.lit(None), "country", "r_name")
        .unionByName(tier("nation", "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "oblast", "n_name"))
        .unionByName(tier("customer", "c", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "city", "c_name"))
        .unionByName(tier("supplier", "s", "s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "hromada", "s_name"))
    )


LOCATIONS_SQL = """loc AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, 'country' AS type, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'oblast', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'city', c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'hromada', s_name FROM supplier
)"""
#: The nearest region of each place: itself or, as the tree has three tiers, its parent.
REGIONS_SQL = """reg AS (
  SELECT l.id AS location_id, CASE WHEN l.type IN ('oblast', 'country') THEN l.id ELSE l.parent_id END AS region_id FROM loc l
)"""
TREE_SQL = """tree AS (
  SELECT id AS descendant_id, id AS ancestor_id, 0 AS depth FROM loc
  UNION ALL SELECT id, parent_id, 1 FROM loc WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.id, b.parent_id, 2 FROM loc a JOIN loc b ON a.parent_id = b.id WHERE b.parent_id IS NOT NULL
)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    tier = F.when(F.col("s_acctbal") >= 6000, "A").when(F.col("s_acctbal") >= 3000, "B").otherwise("C")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), tier.alias("tier"), (F.col("s_suppkey") % 5 == 0).alias("official"), F.concat(F.lit("g"), (F.col("s_nationkey") % 6).cast("string")).alias("independence_group"))


SOURCES_SQL = """src AS (
  SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal >= 6000 THEN 'A' WHEN s_acctbal >= 3000 THEN 'B' ELSE 'C' END AS tier,
    s_suppkey % 5 = 0 AS official, 'g' || (s_nationkey % 6) AS independence_group FROM supplier
)"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    n = tasks(lines)
    if n:
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("l_linenumber") * 3_600_000_000)
    withdrawn = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") > at)
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("event_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("source_id"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 4).cast("string")).alias("independence_group"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("location_id"),
        pick(("uav", "cruise_missile", "artillery", "mlrs"), F.col("l_partkey")).alias("threat_type"),
        at.alias("asserted_at"),
        F.when(withdrawn, F.col("l_shipdate")).alias("withdrawn_at"),
        F.when(withdrawn, F.concat(F.lit("status-"), F.col("l_linestatus"))).alias("withdrawal_reason"),
        (F.col("l_orderkey") % 700).cast("string").alias("asserted_message_id"),
        F.when(withdrawn, (F.col("l_partkey") % 700).cast("string")).alias("withdrawn_message_id"),
    )


ASSERTIONS_SQL = """ta AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'e' || l_orderkey AS event_id, 's' || (l_suppkey % 10) AS source_id,
    'g' || (l_suppkey % 4) AS independence_group, 'c' || o_custkey AS location_id,
    ['uav', 'cruise_missile', 'artillery', 'mlrs'][l_partkey % 4 + 1] AS threat_type, o_orderdate + to_hours(l_linenumber) AS asserted_at,
    CASE WHEN w THEN l_shipdate END AS withdrawn_at, CASE WHEN w THEN 'status-' || l_linestatus END AS withdrawal_reason,
    (l_orderkey % 700)::VARCHAR AS asserted_message_id, CASE WHEN w THEN (l_partkey % 700)::VARCHAR END AS withdrawn_message_id
  FROM (SELECT *, l_returnflag = 'R' AND l_shipdate > o_orderdate + to_hours(l_linenumber) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def r(x: str, digits: int = 4) -> str:
    """The rounding of functions.numbers.rounded, in SQL."""
    return f"floor(({x})::DOUBLE * 1e{digits} + 0.5) / 1e{digits}"


def span(column: str, start: datetime, end: datetime) -> str:
    return f"{column} >= TIMESTAMP '{start}' AND {column} < TIMESTAMP '{end}'"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
