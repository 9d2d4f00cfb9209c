"""Which regions hold which points: ear-clipped triangles in bounding-volume hierarchies.

1. ``triangulate`` cuts each polygon into triangles over its own vertices. Holes are joined to the
   outline by bridges first. If the triangles don't have the polygon's area (rings that cross
   themselves), the polygon is kept as rings and tested by the even-odd rule.
2. ``Hierarchy`` is a binary tree of bounding boxes over the triangles in flat arrays. A batch of points
   walks it together: each node keeps the points in its box.
3. At a leaf the points are tested against each triangle by orientation signs. An edge is always taken
   in the same direction, so the two triangles that share it get the same sign and no point falls between.
4. A point on a shared edge is in both triangles of its region; it is kept once.

Triangles up to ``broadcast_triangles`` go to every task as one hierarchy. Beyond that, the upper levels of
a hierarchy over the regions' boxes become cells: triangles and points meet by an equi join on the cell,
and each cell builds its own hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talaan.operators.near import usable

LEAF = 8


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def _open(ring) -> np.ndarray:
    """The ring without its closing point and without repeated neighbours."""
    pts = np.array([[float(p[0]), float(p[1])] for p in ring if p is not None and len(p) >= 2], dtype=float).reshape(-1, 2)
    if len(pts):
        pts = pts[np.any(pts != np.roll(pts, 1, axis=0), axis=1)]
    return pts if len(pts) >= 3 else np.empty((0, 2))


def _list(rings) -> list:
    return [] if rings is None else list(rings)


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _bridge(outer: list, hole: list) -> list:
    """Join a clockwise hole to a counter-clockwise outline at the outline vertex its rightmost point sees."""
    h = max(range(len(hole)), key=lambda i: hole[i])
    px, py = hole[h]
    best, at, n = None, -1, len(outer)
    for i in range(n):
        (ax, ay), (bx, by) = outer[i], outer[(i + 1) % n]
        if (ay <= py <= by or by <= py <= ay) and ay != by:
            x = ax + (py - ay) * (bx - ax) / (by - ay)
            if x >= px and (best is None or x < best):
                best, at = x, i if ax > bx else (i + 1) % n
    if best is None:
        return outer
    m, q = (best, py), outer[at]
    if q != m:
        tri = (m, (px, py), q) if _cross(m, (px, py), q) > 0 else (m, q, (px, py))
        inside = [
            i for i in range(n)
            if outer[i] != q and all(_cross(tri[k], tri[(k + 1) % 3], outer[i]) >= 0 for k in range(3))
        ]
        inside = [i for i in inside if _cross(outer[i - 1], outer[i], outer[(i + 1) % n]) <= 0]
        if inside:
            at = min(inside, key=lambda i: (abs(outer[i][1] - py) / max(outer[i][0] - px, 1e-300), outer[i][0]))
    same = [i for i in range(n) if outer[i] == outer[at]]
    if len(same) > 1:  # the vertex carries a bridge already: take the copy whose corner opens towards the hole
        def opens(i):
            a, b, c = outer[i - 1], outer[i], outer[(i + 1) % n]
            left, right = _cross(a, b, (px, py)) > 0, _cross(b, c, (px, py)) > 0
            return (left and right) if _cross(a, b, c) > 0 else (left or right)
        at = next((i for i in same if opens(i)), at)
    return outer[: at + 1] + hole[h:] + hole[: h + 1] + outer[at:]


def triangulate(rings) -> tuple[np.ndarray, bool]:
    """Triangles ``(n, 3, 2)`` of a polygon (outline, then holes), and whether they cover it exactly."""
    parts = [r for r in (_open(r) for r in _list(rings) if r is not None)]
    if not parts or not len(parts[0]):
        return np.empty((0, 3, 2)), True
    outline = parts[0] if _area(parts[0]) > 0 else parts[0][::-1]
    holes = [r if _area(r) < 0 else r[::-1] for r in parts[1:] if len(r)]
    want = _area(outline) + sum(_area(h) for h in holes)
    poly = [tuple(p) for p in outline]
    for hole in sorted(([tuple(p) for p in h] for h in holes), key=lambda h: -max(h)[0]):
        poly = _bridge(poly, hole)
    out, idx = [], list(range(len(poly)))
    pts = np.array(poly)
    while len(idx) > 3:
        clipped = False
        ring = pts[idx]
        for k in range(len(idx)):
            i, j, m = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            a, b, c = poly[i], poly[j], poly[m]
            turn = _cross(a, b, c)
            if turn < 0 or (turn == 0 and a != c and b not in (a, c) and not _between(a, b, c)):
                continue
            if turn > 0:
                s0 = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
                s1 = (c[0] - b[0]) * (ring[:, 1] - b[1]) - (c[1] - b[1]) * (ring[:, 0] - b[0])
                s2 = (a[0] - c[0]) * (ring[:, 1] - c[1]) - (a[1] - c[1]) * (ring[:, 0] - c[0])
                hit = (s0 >= 0) & (s1 >= 0) & (s2 >= 0)
                for v in (a, b, c):
                    hit &= ~((ring[:, 0] == v[0]) & (ring[:, 1] == v[1]))
                if hit.any():
                    continue
                out.append((a, b, c))
            idx.pop(k)
            clipped = True
            break
        if not clipped:
            break
    if len(idx) == 3:
        a, b, c = (poly[i] for i in idx)
        if _cross(a, b, c) > 0:
            out.append((a, b, c))
    tri = np.array(out, dtype=float).reshape(-1, 3, 2)
    got = sum(0.5 * _cross(*t) for t in tri)
    return tri, bool(len(idx) <= 3 and abs(got - want) <= 1e-9 * max(abs(want), 1e-12))


def _between(a, b, c) -> bool:
    return min(a[0], c[0]) <= b[0] <= max(a[0], c[0]) and min(a[1], c[1]) <= b[1] <= max(a[1], c[1])


def _side(a: np.ndarray, b: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Orientation of the points against edge ab; the edge is always computed from its smaller end."""
    flip = tuple(a) > tuple(b)
    if flip:
        a, b = b, a
    s = (b[0] - a[0]) * (py - a[1]) - (b[1] - a[1]) * (px - a[0])
    return -s if flip else s


def in_triangle(t: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Points in a counter-clockwise triangle, its edges included."""
    return (_side(t[0], t[1], px, py) >= 0) & (_side(t[1], t[2], px, py) >= 0) & (_side(t[2], t[0], px, py) >= 0)


def even_odd(rings, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Points inside by crossings of all rings; used for polygons that can't be triangulated."""
    inside = np.zeros(len(px), bool)
    for ring in _list(rings):
        pts = _open(ring) if ring is not None else np.empty((0, 2))
        for (ax, ay), (bx, by) in zip(pts, np.roll(pts, -1, axis=0)):
            if ay != by:
                inside ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return inside


class Hierarchy:
    """Boxes over triangles; ``owner[i]`` is the region of triangle ``i``."""

    def __init__(self, tri: np.ndarray, owner: np.ndarray):
        self.tri, self.owner = tri, owner
        lo, hi = tri.min(axis=1), tri.max(axis=1)
        mid = (lo + hi) / 2
        self.nodes: list[tuple] = []

        def build(ids: np.ndarray) -> int:
            box = (*lo[ids].min(axis=0), *hi[ids].max(axis=0))
            at = len(self.nodes)
            self.nodes.append(())
            if len(ids) <= LEAF:
                self.nodes[at] = (box, ids, None)
            else:
                axis = int(np.argmax(mid[ids].max(axis=0) - mid[ids].min(axis=0)))
                order = ids[np.argsort(mid[ids, axis], kind="stable")]
                half = len(order) // 2
                self.nodes[at] = (box, build(order[:half]), build(order[half:]))
            return at

        if len(tri):
            build(np.arange(len(tri)))

    def find(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, region) of every hit, each once."""
        pts, regs = [], []
        stack = [(0, np.arange(len(px)))] if self.nodes and len(px) else []
        while stack:
            at, ids = stack.pop()
            (x0, y0, x1, y1), left, right = self.nodes[at]
            x, y = px[ids], py[ids]
            ids = ids[(x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)]
            if not len(ids):
                continue
            if right is None:
                for t in left:
                    hit = ids[in_triangle(self.tri[t], px[ids], py[ids])]
                    pts.append(hit)
                    regs.append(np.full(len(hit), self.owner[t]))
            else:
                stack += [(left, ids), (right, ids)]
        if not pts:
            return np.empty(0, int), np.empty(0, int)
        both = np.unique(np.stack([np.concatenate(pts), np.concatenate(regs)]), axis=1)
        return both[0], both[1]


TRIANGLES = "area string, tri array<double>, rings array<array<array<double>>>"


def triangles(areas: DataFrame, area: str, rings: str) -> DataFrame:
    """One row per triangle; a polygon that can't be triangulated is one row with its rings and its box."""

    def cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, rr in zip(pdf["area"], pdf["rings"]):
                tri, exact = triangulate(rr)
                if exact:
                    rows += [(key, t.ravel().tolist(), None) for t in tri]
                else:
                    pts = np.concatenate([_open(r) for r in rr if r is not None])
                    (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
                    rows.append((key, [x0, y0, x1, y0, x1, y1], [[[float(v) for v in p] for p in r] for r in rr if r is not None]))
                    rows.append((key, [x0, y0, x1, y1, x0, y1], rows[-1][2]))
            yield pd.DataFrame(rows, columns=["area", "tri", "rings"], dtype=object)

    src = areas.select(F.col(area).cast("string").alias("area"), F.col(rings).alias("rings")).where("area is not null and rings is not null")
    return src.mapInPandas(cut_batches, TRIANGLES)


def _index(tri_rows) -> tuple[Hierarchy, list, dict]:
    names, owner, tri, rings = [], [], [], {}
    ids: dict = {}
    for area, t, rr in tri_rows:
        i = ids.setdefault((area, rr is not None and len(rr) > 0), len(ids))
        if i == len(names):
            names.append(area)
        owner.append(i)
        tri.append(np.asarray(t, float).reshape(3, 2))
        if rr is not None and len(rr):
            rings[i] = rr
    return Hierarchy(np.array(tri).reshape(-1, 3, 2), np.array(owner, int)), names, rings


def _probe(index, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, list]:
    tree, names, rings = index
    pts, regs = tree.find(px, py)
    keep = np.ones(len(pts), bool)
    for r, rr in rings.items():
        at = np.flatnonzero(regs == r)
        keep[at] = even_odd(rr, px[pts[at]], py[pts[at]])
    return pts[keep], [names[r] for r in regs[keep]]


def regions_of_points(
    points: DataFrame, key: str, lat: str, lon: str, areas: DataFrame, area: str, rings: str,
    broadcast_triangles: int = 200_000, cell_deg: float = 1.0,
) -> DataFrame:
    """``area``, ``key``: each region with each key in it, once.

    Inside means inside the outline and in no hole, with straight edges in degrees. Null keys, null or
    empty rings and unusable positions give nothing. Repeated rows count once.
    """
    spark = points.sparkSession
    pts = points.select(F.col(key).cast("string").alias("key"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    pts = pts.where(F.col("key").isNotNull() & usable(F.col("y"), F.col("x")))
    tri = triangles(areas, area, rings)
    rows = tri.limit(broadcast_triangles + 1).collect()
    if len(rows) <= broadcast_triangles:
        shared = spark.sparkContext.broadcast([(r.area, r.tri, r.rings) for r in rows])

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shared.value)
            for pdf in batches:
                at, names = _probe(index, pdf["x"].to_numpy(), pdf["y"].to_numpy())
                yield pd.DataFrame({"area": names, "key": pdf["key"].to_numpy(dtype=object)[at].tolist()}, dtype=object)

        return pts.mapInPandas(probe, "area string, key string").distinct()

    # Too many triangles for one task: meet on the cells of the hierarchy's upper level. Each triangle goes to the
    # cells its box touches; a cell with many points is split by a salt, its triangles are repeated per salt.
    salts = 16
    box = tri.select(
        "area", "tri", "rings",
        F.floor(F.least(F.col("tri")[0], F.col("tri")[2], F.col("tri")[4]) / cell_deg).alias("x0"),
        F.floor(F.greatest(F.col("tri")[0], F.col("tri")[2], F.col("tri")[4]) / cell_deg).alias("x1"),
        F.floor(F.least(F.col("tri")[1], F.col("tri")[3], F.col("tri")[5]) / cell_deg).alias("y0"),
        F.floor(F.greatest(F.col("tri")[1], F.col("tri")[3], F.col("tri")[5]) / cell_deg).alias("y1"),
    )
    t = box.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("cx", "cy", "salt", "area", "tri", "rings")
    p = pts.select(
        "key", "x", "y", F.floor(F.col("x") / cell_deg).alias("cx"), F.floor(F.col("y") / cell_deg).alias("cy"),
        F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"),
    )

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"area": [], "key": []}, dtype=object)
        index = _index(zip(right["area"], right["tri"], right["rings"]))
        at, names = _probe(index, left["x"].to_numpy(), left["y"].to_numpy())
        return pd.DataFrame({"area": names, "key": left["key"].to_numpy(dtype=object)[at].tolist()}, dtype=object)

    by = ("cx", "cy", "salt")
    return p.groupBy(*by).cogroup(t.groupBy(*by)).applyInPandas(cell, "area string, key string").distinct()
