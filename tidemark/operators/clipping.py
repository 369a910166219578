"""Layers clipped to boundaries: intersections of polygons with holes and of several parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Side of a grid cell, in degrees.
CELL = 1.0
LEAST_AREA = 1e-12


def _edges(rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """Rows (x1, y1, x2, y2) with x1 < x2 of all sides; upright ones bound no area from above or below."""
    sides = [np.stack([np.asarray(r, float), np.roll(np.asarray(r, float), -1, 0)], 1).reshape(-1, 4) for r in rings if len(r) >= 3]
    if not sides:
        return np.zeros((0, 4))
    e = np.concatenate(sides)
    e = e[np.isfinite(e).all(1) & (e[:, 0] != e[:, 2])]
    turned = e[:, 0] > e[:, 2]
    e[turned] = e[turned][:, [2, 3, 0, 1]]
    return e


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of the points in which sides cross, row by row, so that memory follows the number of sides."""
    found = []
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    for i in range(len(e) - 1):
        o = slice(i + 1, None)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = ((e[o, 1] - slope[o] * e[o, 0]) - (e[i, 1] - slope[i] * e[i, 0])) / (slope[i] - slope[o])
        found.append(x[(x > np.maximum(e[i, 0], e[o, 0])) & (x < np.minimum(e[i, 2], e[o, 2]))])
    return np.concatenate(found) if found else np.zeros(0)


def _inside(e: np.ndarray, left: float, right: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y at both ends, in pairs from below, of the sides over a slab that no vertex or crossing lies within."""
    over = e[(e[:, 0] <= left) & (e[:, 2] >= right)]
    slope = (over[:, 3] - over[:, 1]) / (over[:, 2] - over[:, 0])
    a, b = over[:, 1] + slope * (left - over[:, 0]), over[:, 1] + slope * (right - over[:, 0])
    order = np.argsort(a + b, kind="stable")
    return a[order], b[order], (a + b)[order]


def intersection(one: list, other: list) -> list[list[tuple[float, float]]]:
    """Trapezoids that the intersection of two regions consists of, by the even-odd rule; a region is a list of rings, in
    any order and direction, holes among them.

    Slabs between the xs of all vertices and crossings: within one, sides don't cross, so both regions are runs between
    sides in order of y, and the intersection is where the runs overlap."""
    a, b = _edges(one), _edges(other)
    if not len(a) or not len(b):
        return []
    both = np.concatenate([a, b])
    low, high = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 2].max(), b[:, 2].max())
    xs = np.unique(np.concatenate([both[:, 0], both[:, 2], _crossings(both)]))
    xs = xs[(xs >= low) & (xs <= high)]
    out = []
    for left, right in zip(xs[:-1], xs[1:]):
        pa_, pb = _inside(a, left, right), _inside(b, left, right)
        i = j = 0
        while i + 1 < len(pa_[2]) and j + 1 < len(pb[2]):
            under = (pa_, i) if pa_[2][i] >= pb[2][j] else (pb, j)
            above = (pa_, i + 1) if pa_[2][i + 1] <= pb[2][j + 1] else (pb, j + 1)
            if above[0][2][above[1]] > under[0][2][under[1]]:
                (u, k), (t, m) = under, above
                out.append([(float(left), float(u[0][k])), (float(right), float(u[1][k])), (float(right), float(t[1][m])), (float(left), float(t[0][m]))])
            if pa_[2][i + 1] <= pb[2][j + 1]:
                i += 2
            else:
                j += 2
    return [p for p in out if trapezoid_area(p) > LEAST_AREA]


def trapezoid_area(p: list[tuple[float, float]]) -> float:
    return (p[1][0] - p[0][0]) * ((p[3][1] - p[0][1]) + (p[2][1] - p[1][1])) / 2


def _box(rings: Column) -> Column:
    axis = lambda a: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[a])))
    return F.struct(*(f(axis(a)).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("least", F.array_min), ("most", F.array_max))))


def _cells(box: str, cell: float) -> Column:
    at = lambda v: F.floor(F.col(f"{box}.{v}") / cell)
    return F.explode(F.transform(F.sequence(at("least_x"), at("most_x")), lambda x: F.transform(F.sequence(at("least_y"), at("most_y")), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def candidate_pairs(layers: DataFrame, boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """(layer_id, boundary_id) whose boxes meet, each once: both are dealt to the grid cells that their boxes touch, and a
    pair is kept by the first cell that they share, so that nothing must be made distinct."""
    side = lambda df, key, box: df.select(key, _box(F.col("rings")).alias(box)).where(F.col(f"{box}.least_x").isNotNull())
    a, b = (side(df, key, box).select(key, box, _cells(box, cell).alias("row")).select(key, box, F.explode("row").alias("c")) for df, key, box in ((layers, "layer_id", "a"), (boundaries, "boundary_id", "b")))
    met = a.join(b, "c")
    overlap = (F.col("a.least_x") <= F.col("b.most_x")) & (F.col("b.least_x") <= F.col("a.most_x")) & (F.col("a.least_y") <= F.col("b.most_y")) & (F.col("b.least_y") <= F.col("a.most_y"))
    first = (F.col("c.cx") == F.floor(F.greatest("a.least_x", "b.least_x") / cell)) & (F.col("c.cy") == F.floor(F.greatest("a.least_y", "b.least_y") / cell))
    return met.where(overlap & first).select("layer_id", "boundary_id")


def clipped(layers: DataFrame, boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """(layer_id, boundary_id, area, pieces) of the layers that reach into a boundary. layers: (layer_id, rings), boundaries:
    (boundary_id, rings), rings an array of arrays of struct<x, y>; ids are of one row each. A ring of fewer than three points,
    or without area, bounds nothing; null rings are none; what only touches is outside. pieces are trapezoids, area is theirs
    in square degrees. A layer that is in no row lies outside every boundary. Layers of equal rings are clipped once."""
    owners = layers.groupBy("rings").agg(F.min("layer_id").alias("owner"))
    shapes = owners.where(F.col("owner").isNotNull()).select(F.col("owner").alias("layer_id"), "rings")
    pairs = candidate_pairs(shapes, boundaries, cell)
    rows = pairs.join(shapes.select("layer_id", F.col("rings").alias("one")), "layer_id").join(boundaries.select("boundary_id", F.col("rings").alias("other")), "boundary_id")
    # few bytes make much work, so pairs are dealt to a fixed number of tasks
    n = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f for f in rows.schema.fields if f.name in ("layer_id", "boundary_id")]
    rows = rows.select(*(f.name for f in keys), "one", "other").repartition(n, "layer_id", "boundary_id")
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = lambda rings: [[(p["x"], p["y"]) for p in r if p and p["x"] is not None and p["y"] is not None] for r in rings or [] if r]
        for batch in batches:
            for i in range(batch.num_rows):
                pieces = intersection(points(batch.column(2)[i].as_py()), points(batch.column(3)[i].as_py()))
                if pieces:
                    shown = [[{"x": x, "y": y} for x, y in p] for p in pieces]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([sum(map(trapezoid_area, pieces))]), pa.array([shown], kind)], [keys[0].name, keys[1].name, "area", "pieces"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    cut = rows.mapInArrow(run, f"{schema}, area double, pieces array<array<struct<x:double,y:double>>>")
    named = layers.where(F.col("rings").isNotNull()).join(owners, "rings").select("layer_id", "owner")
    return named.join(cut.withColumnRenamed("layer_id", "owner"), "owner").select(*(f.name for f in keys), "area", "pieces")
