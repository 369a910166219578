"""Bulletins, told nights and decisions in the cases that the queries don't deal."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.comparing import same
from tidemark.functions import bulletins as T
from tidemark.operators import planning as P
from tidemark.plans.planning_queries import QUERIES


def test_bulletins_of_odd_texts(spark):
    texts = [None, "", "#тег", "🟠 Повітряна тривога в Буча", "🔴 Новий вигляд", "🔴 Відбій тривоги в Буча", "🔴 Повітряна тривога в", "🔴️ 9:05 Повітряна тривога в\n• Могилів-Подільський район;\nтекст"]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, kind int")
    out = {r.id: (r.bulletin.kind, r.bulletin.reason, r.bulletin.clock, r.bulletin.names) for r in T.with_bulletin(rows).collect()}
    assert out == {
        0: ("ignored", "empty", None, None),
        1: ("ignored", "empty", None, None),
        2: ("ignored", "empty", None, None),
        3: ("ignored", "advisory", None, None),
        4: ("unrecognized", None, None, None),
        5: ("unrecognized", None, None, None),
        6: ("unrecognized", None, None, None),
        7: ("event", None, "9:05", ["Могилів-Подільський район"]),
    }
    assert T.with_bulletin(rows).columns == ["id", "text", "kind", "bulletin"] and T.with_bulletin(rows.limit(0)).count() == 0


def test_essays(spark):
    sentence = "Того дня над містом було чути далекий гул моторів, і люди стояли біля вікон. "
    rows = spark.createDataFrame([(1, sentence * 6), (2, sentence * 2), (3, "Було. " * 100), (4, None), (5, sentence.replace("було чути", "чутно") * 6)], "id int, text string")
    out = {r.id: (r.s.verdict, r.s.told) for r in rows.select("id", T.retrospective(F.col("text")).alias("s")).collect()}
    assert out == {1: ("vetoed", ["essay"]), 2: ("none", []), 3: ("none", []), 4: ("none", []), 5: ("none", [])}


def test_allowances_against_a_loop(spark):
    dice, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(b, i, start + dt.timedelta(seconds=dice.randrange(4000)), dice.randrange(30)) for b in ("a", None, "b") for i in range(150)]
    want = {}
    for bucket in ("a", None, "b"):
        tokens, last = 30.0, None
        for b, i, at, wanted in sorted((r for r in rows if r[0] == bucket), key=lambda r: (r[2], r[1])):
            tokens = min(30.0, tokens + ((at - last).total_seconds() if last else 0) * 0.25)
            want[b, i] = min(25, int(tokens), wanted)
            tokens, last = tokens - want[b, i], at
    got = P.allowances(spark.createDataFrame(rows, "bucket string, id int, at timestamp, wanted int"), 0.25, 30).collect()
    assert {(r.bucket, r.id): r.allowed for r in got} == want and len(got) == len(rows)


def test_cone_ring_is_closed_and_within_reach(spark):
    ring = spark.range(1).select(P.cone_ring(F.lit(50.0), F.lit(30.0), F.lit(90.0), F.lit(100.0), F.lit(20.0), F.lit(8.0)).alias("ring")).first().ring
    assert len(ring) == 27 and ring[0] == ring[-1]
    rows = spark.createDataFrame([tuple(p) for p in ring], "lon double, lat double")
    km = [r[0] for r in rows.select(P.distance_km(F.lit(50.0), F.lit(30.0), F.col("lat"), F.col("lon"))).collect()]
    assert all(abs(x - 137) < 1e-6 or abs(x - 65) < 1e-6 for x in km) and sum(abs(x - 65) < 1e-6 for x in km) == 13


def test_plans_of_nulls_and_nothing(spark):
    entries = spark.createDataFrame([("a", ["x", "b"]), ("b", None), (None, ["a"])], "code string, parent_codes array<string>")
    present = spark.createDataFrame([("a", None)], "code string, parent_code string")
    assert {r.code: (r.parent_code, r.moved) for r in P.chosen_parents(entries, present).collect()}["a"] == ("b", True)
    assert P.chosen_parents(entries.limit(0), present).count() == 0
    mentions = spark.createDataFrame([(1, 0, "zz"), (1, 1, "zz"), (2, 0, "ua"), (3, 0, None)], "message_id int, n int, location_id string")
    regions = spark.createDataFrame([("zz", "ua")], "location_id string, region_id string")
    assert {r.message_id: r.places for r in P.context_places(mentions, regions, "ua").collect()} == {1: ["zz", "ua"], 2: ["ua"], 3: ["ua"]}


def test_queries_at_a_larger_scale(spark, medium):
    for query, sql in QUERIES.values():
        same(query, sql, spark, medium)


def test_cones_of_many_equal_sectors_and_points(spark):
    """20,000 events of one sector and 20,000 places at one point are no pairs of all; a sector over the date line, and an
    event of two sectors."""
    import time

    began = time.perf_counter()
    sector = {"lat0": 48.0, "lon0": 179.5, "towards": 90.0, "horizon_km": 100.0, "half_angle": 30.0, "speed_kmh": 100.0}
    constant = lambda df, values: df.select("*", *(F.lit(v).alias(c) for c, v in values.items()))
    crowd = constant(spark.range(20_000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id")), {"type": "city", "lat": 48.1, "lon": -179.3})
    others = spark.createDataFrame([("o", "oblast", 48.1, -179.3), ("far", "city", 48.0, -170.0), ("near", "city", 48.0, -179.2), ("west", "city", 48.0, 178.2)], "id string, type string, lat double, lon double")
    origins = constant(spark.range(20_000).select(F.col("id").alias("event_id")), sector)
    both = origins.unionByName(constant(spark.createDataFrame([(0,)], "event_id long"), {**sector, "towards": 270.0}))
    out = P.cone_candidates(both, crowd.unionByName(others))
    got = out.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x")).groupBy(F.transform("x", lambda r: r["id"]).alias("ids")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).collect()
    assert sorted((r.n, r.first, r.ids) for r in got) == [(1, 0, ["west", "near", "p00000"]), (19_999, 1, ["near", "p00000"])] and time.perf_counter() - began < 60
