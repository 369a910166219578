"""Clipped polygons against sampling, and reported vectors by hand."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clipping as C, vectors as V

T0 = datetime(2024, 1, 1)


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, size, points):
    return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / points), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / points)) for i in range(points)]


def test_areas_against_sampling():
    rng = random.Random(5)
    for _ in range(12):
        one = [star(rng, 0, 0, 3, 9), star(rng, 0, 0, 0.7, 5), star(rng, 5, 0, 1, 4)]
        other = [star(rng, 1, 0.5, 3, 7), star(rng, 1, 0.5, 0.5, 4)]
        area = sum(map(C.trapezoid_area, C.intersection(one, other)))
        grid = [(-4 + 11 * (i + 0.5) / 220, -4 + 8 * (j + 0.5) / 160) for i in range(220) for j in range(160)]
        sampled = sum(inside(one, *p) and inside(other, *p) for p in grid) * (11 / 220) * (8 / 160)
        assert area == pytest.approx(sampled, abs=0.35) and area == pytest.approx(sum(map(C.trapezoid_area, C.intersection(other, one))), abs=1e-9)


def test_known_areas_and_odd_rings():
    square, turned = [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(0, -math.sqrt(2)), (math.sqrt(2), 0), (0, math.sqrt(2)), (-math.sqrt(2), 0)]
    total = lambda a, b: sum(map(C.trapezoid_area, C.intersection(a, b)))
    assert total([square], [turned]) == pytest.approx(8 * (math.sqrt(2) - 1))
    assert total([square], [square]) == pytest.approx(4) and total([square, [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]], [square]) == pytest.approx(3)
    assert total([square], [[(1, -1), (2, -1), (2, 1), (1, 1)]]) == 0 and total([square], [[(0, 0), (0, 1)]]) == 0 and total([], [square]) == 0


def test_layers_meet_boundaries_of_their_cells_once(spark):
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    schema = "{} int, rings array<array<struct<x:double,y:double>>>"
    layers = spark.createDataFrame([(1, box(0.0, 0.0, 5.0)), (2, box(50.0, 50.0, 1.0)), (3, None), (4, []), (5, [[]]), (6, box(-0.5, -0.5, 1.0))], schema.format("layer_id"))
    boundaries = spark.createDataFrame([(1, box(1.0, 1.0, 3.0)), (2, box(4.5, 4.5, 2.0)), (3, box(5.0, 0.0, 1.0))], schema.format("boundary_id"))
    got = C.clipped(layers, boundaries).collect()
    assert sorted((r.layer_id, r.boundary_id, round(r.area, 9)) for r in got) == [(1, 1, 9.0), (1, 2, 0.25)]
    assert C.candidate_pairs(layers, boundaries).count() == 3 and C.clipped(layers.limit(0), boundaries).count() == 0


def test_a_vector_by_hand(spark):
    def row(report, minute, role, relation, place, kind, source, group, tier="B", official=False, redirect=False, lat=1.0):
        return ("e", report, T0 + timedelta(minutes=minute), redirect, role, relation, place, kind, lat, 2.0, source, group, tier, official, "uav")

    rows = [
        row("a", 0, "asserted", "mentioned", "bila", "city", "s1", "g1"), row("a", 0, "asserted", "mentioned", "kyiv_o", "oblast", "s1", "g1"),
        row("b", 5, "asserted", "mentioned", "bila", "city", "s2", "g2"),
        row("c", 9, "retracted", "mentioned", "fastiv", "city", "s3", "g3", redirect=True), row("c", 9, "asserted", "reported_direction", "obukhiv", "city", "s3", "g3", redirect=True, lat=None),
        row("d", 9, "asserted", "reported_direction", "stuhna", "city", "s1", "g1", official=True),
    ]
    df = spark.createDataFrame(rows, "event_id string, report_id string, at timestamp, redirect boolean, role string, relation string, location_id string, type string, lat double, lon double, source_id string, independence_group string, tier string, official boolean, threat_type string")
    legs = [(r.from_id, r.to_id, r.basis, r.seconds, r.evidence, r.independent, r.drawable) for r in V.legs(V.positions(df)).orderBy("at", "report_id", "offset").collect()]
    assert legs == [
        ("bila", "fastiv", "observation_sequence", 240, "confirmed", True, True),
        ("fastiv", "obukhiv", "reported_transit", 0, "monitoring", False, False),
        ("obukhiv", "stuhna", "observation_sequence", 0, "official", True, False),
    ]
    (whole,) = V.reported_vectors(df).collect()
    assert (whole.nodes, whole.legs, whole.drawable_legs, whole.sources, whole.independence_groups, whole.strongest_basis, whole.confirmed_legs, whole.seconds) == (4, 3, 1, 3, 3, "reported_transit", 1, 540)
    (alone,) = V.reported_vectors(df.where("report_id = 'a'")).collect()
    assert (alone.nodes, alone.legs, alone.strongest_basis) == (1, 0, None) and V.reported_vectors(df.limit(0)).count() == 0


def test_equal_layers_are_clipped_once(spark):
    import time

    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    layers = spark.range(400_000).select(F.col("id").alias("layer_id"), F.when(F.col("id") != 7, F.array(ring)).alias("rings"))
    began = time.perf_counter()
    out = C.clipped(layers, spark.range(2).select(F.col("id").alias("boundary_id"), F.array(ring).alias("rings")))
    assert [tuple(r) for r in out.groupBy("boundary_id", "area").agg(F.count_distinct("layer_id")).orderBy("boundary_id").collect()] == [(0, 16.0, 399_999), (1, 16.0, 399_999)]
    assert time.perf_counter() - began < 40
