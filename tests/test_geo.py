import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talaan.operators.near import near_pairs
from talaan.operators.regions import even_odd, regions_of_points, triangulate


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def star(rng, n=17, cx=0.0, cy=0.0, r=1.0):
    radii = [r * rng.uniform(0.5, 1) for _ in range(n)]
    pts = [(cx + q * math.cos(2 * math.pi * i / n), cy + q * math.sin(2 * math.pi * i / n)) for i, q in enumerate(radii)]
    return [list(p) for p in pts + pts[:1]]


@pytest.mark.parametrize("base", [(14.55, 121.02), (89.9995, 10.0), (-89.9999, 0.0), (0.0003, 180.0), (60.0, -179.9999)])
def test_near_pairs_equals_brute_force(spark, base):
    rng = random.Random(7)
    pts = {}
    for i in range(250):
        lat = max(-90.0, min(90.0, base[0] + rng.uniform(-0.0015, 0.0015)))
        lon = base[1] + rng.uniform(-0.002, 0.002) / max(0.05, math.cos(math.radians(lat)))
        pts[f"k{i:03}"] = (lat, (lon + 180) % 360 - 180)
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "lead_id string, lat double, lon double")
    got = {tuple(r) for r in near_pairs(df.union(df), "lead_id", "lat", "lon", 50).collect()}
    keys = sorted(pts)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if metres(pts[a], pts[b]) <= 50}
    assert got == want and want


def test_near_pairs_skips_unusable_positions_and_clashing_columns(spark):
    rows = [("a", 0.0, 0.0, 1), ("b", 0.0, 0.0, 1), (None, 1.0, 1.0, 1), ("c", 1.0, 1.0, 1), ("d", 1.0, 1.0, 2), ("e", 91.0, 1.0, 2), ("f", float("nan"), 1.0, 2), ("g", None, None, 3)]
    df = spark.createDataFrame(rows, "lead_id string, lat double, lon double, cell int")
    assert [tuple(r) for r in near_pairs(df, "lead_id", "lat", "lon", 50).collect()] == [("c", "d")]
    assert near_pairs(df.limit(0), "lead_id", "lat", "lon", 50).count() == 0


def test_triangles_cover_polygons_with_holes():
    rng = random.Random(3)
    for k in range(60):
        outer = star(rng, rng.randint(6, 40))
        holes = [star(rng, rng.randint(3, 9), 0.12 * math.cos(h * 2.1 + k), 0.12 * math.sin(h * 2.1 + k), 0.06) for h in range(k % 4)]
        tri, exact = triangulate([outer, *holes])
        assert exact, k
        assert len(tri) == len(outer) - 1 + sum(len(h) - 1 for h in holes) + 2 * len(holes) - 2


@pytest.mark.parametrize("limit", [200_000, 0])
def test_regions_equal_even_odd(spark, limit):
    rng = random.Random(5)
    areas = []
    for k in range(12):
        cx, cy = rng.uniform(120, 122), rng.uniform(10, 12)
        areas.append((f"A-{k:02}", [star(rng, 20, cx, cy), star(rng, 6, cx, cy, 0.2)]))
    areas.append(("bow", [[[121.0, 11.0], [122.0, 12.0], [122.0, 11.0], [121.0, 12.0], [121.0, 11.0]]]))
    areas += [("none", None), ("flat", [[[1.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]), (None, areas[0][1])]
    pts = [(f"p{i}", rng.uniform(9.5, 12.5), rng.uniform(119.5, 122.5)) for i in range(2000)]
    adf = spark.createDataFrame(areas, "area_id string, rings array<array<array<double>>>")
    pdf = spark.createDataFrame(pts + [("bad", 0.0, 0.0), ("null", None, 121.0)], "lead_id string, lat double, lon double").withColumn("area", F.lit("x"))
    got = {tuple(r) for r in regions_of_points(pdf, "lead_id", "lat", "lon", adf, "area_id", "rings", broadcast_triangles=limit).collect()}
    x, y = np.array([p[2] for p in pts]), np.array([p[1] for p in pts])
    want = {(a, pts[i][0]) for a, rr in areas if a and rr for i in np.flatnonzero(even_odd(rr, x, y))}
    assert got == want and len(want) > 500


def test_shared_edges_belong_to_one_row_each(spark):
    square = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]
    adf = spark.createDataFrame([("s", square), ("s", square)], "area_id string, rings array<array<array<double>>>")
    pdf = spark.createDataFrame([("mid", 1.0, 1.0), ("mid", 1.0, 1.0)], "lead_id string, lat double, lon double")
    assert regions_of_points(pdf, "lead_id", "lat", "lon", adf, "area_id", "rings").count() == 1
