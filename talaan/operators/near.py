"""Pairs of points within a distance, as an equi join on grid cells.

A cell is as high and wide as twice the radius, so a point's neighbourhood overlaps few cells. The left
side keeps its own cell; the right side is repeated into every cell its neighbourhood touches. Each
ordered pair of points then meets in exactly one cell, and ``key_a < key_b`` keeps one of the two orders.
Longitude widths are set per row of cells from the row's highest latitude, so the join is exact up to
the poles and across the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere of radius 6,371,000 m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable(lat: Column, lon: Column) -> Column:
    """Complete, in range, and not the 0, 0 of an unset position. NaN counts as missing."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return ok & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def _row_width(row: Column, height: float, radius_deg: float) -> Column:
    """Degrees of longitude of a cell in this row: as wide as high at the row's highest latitude, or 360."""
    top = F.least(F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + radius_deg, F.lit(90.0))
    cos = F.cos(F.radians(top))
    return F.when(cos < 1e-3, F.lit(360.0)).otherwise(F.least(F.lit(360.0), height / cos))


def cells(df: DataFrame, lat: str, lon: str, radius_m: float, reach: bool, name: str = "cell", cell_m: float | None = None) -> DataFrame:
    """``df`` with the cell of each point, or (``reach``) once per cell within ``radius_m`` of it.

    Cells are ``cell_m`` high, twice the radius if not given; larger ones repeat fewer points.
    """
    r = math.degrees(radius_m / EARTH_M) * 1.0001
    height = max(2 * r, math.degrees((cell_m or 0) / EARTH_M))
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")

    def key(row: Column, col: Column) -> Column:
        return F.xxhash64(row.cast("long"), col.cast("long"))

    def columns(row: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.lit(360.0) / _row_width(row, height, r)))

    if not reach:
        row = F.floor((y + 90) / height)
        base = row - F.floor(F.lit(90.0) / height)
        n = columns(base)
        return df.withColumn(name, key(row, F.pmod(F.floor((x + 180) / 360 * n), n)))
    rows = F.sequence(F.floor((y + 90 - r) / height), F.floor((y + 90 + r) / height))
    off = F.floor(F.lit(90.0) / height)

    def across(row: Column) -> Column:
        n = columns(row - off)
        half = n * F.when(F.cos(F.radians(F.least(F.abs(y) + r, F.lit(90.0)))) < 1e-3, F.lit(0.5)).otherwise(
            F.least(F.lit(0.5), r / F.cos(F.radians(F.least(F.abs(y) + r, F.lit(90.0)))) / 360)
        )
        at = (x + 180) / 360 * n
        return F.transform(
            F.sequence(F.floor(at - half), F.floor(at + half)), lambda c: key(row, F.pmod(c, n))
        )

    return df.withColumn(name, F.explode(F.array_distinct(F.flatten(F.transform(rows, across)))))


def touched_cells(lat: Column, lon: Column, radius_m: float, cell_m: float) -> Column:
    """The cells within ``radius_m`` of a point as an array, the point's own cell first.

    The same cells as ``cells`` gives, without lambdas: away from the poles a neighbourhood touches at most two rows and
    two columns of each.
    """
    r = math.degrees(radius_m / EARTH_M) * 1.0001
    height = max(2 * r, math.degrees(cell_m / EARTH_M))
    y, x = lat.cast("double"), lon.cast("double")
    off = F.floor(F.lit(90.0) / height)
    far = F.least(F.abs(y) + r, F.lit(90.0))
    polar = F.cos(F.radians(far)) < 0.01

    def grid(row: Column, shift: Column | float) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.lit(360.0) / _row_width(row - off, height, r)))
        at = (x + 180) / 360 * n + shift * n
        return F.xxhash64(row.cast("long"), F.pmod(F.floor(at), n).cast("long"))

    half = r / F.cos(F.radians(far)) / 360
    rows = [F.floor((y + 90 - r) / height), F.floor((y + 90 + r) / height)]
    own = grid(F.floor((y + 90) / height), F.lit(0.0))
    few = F.array_distinct(F.array(own, *(grid(row, s * half) for row in rows for s in (-1, 1))))
    n = F.greatest(F.lit(1), F.ceil(F.lit(360.0) / _row_width(F.floor((y + 90) / height) - off, height, r)))
    at = (x + 180) / 360 * n
    inside = (rows[0] == rows[1]) & (F.floor(at - half * n) == F.floor(at + half * n))  # most points are far from their cell's sides
    top = F.when(y > 0, F.floor((F.lit(180.0) - r) / height)).otherwise(F.lit(0))
    ring = F.flatten(F.transform(
        F.sequence(F.greatest(rows[0] - 1, F.lit(0)), F.greatest(rows[1] + 1, top)),
        lambda row: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.lit(360.0) / _row_width(row - off, height, r))) - 1), lambda c: F.xxhash64(row.cast("long"), c.cast("long"))),
    ))
    return F.when(polar, F.array_distinct(F.concat(F.array(own), ring))).when(inside, F.array(own)).otherwise(few)


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """``key_a``, ``key_b``: each two different keys at most ``radius_m`` apart, once, smaller key first.

    Null keys and unusable positions are in no pair; repeated rows count once; a key with several
    positions is near whatever any of them is near. Other columns of ``points`` are ignored.
    """
    p = (
        points.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
        .where(F.col("k").isNotNull() & usable(F.col("y"), F.col("x")))
        .distinct()
    )
    a = cells(p, "y", "x", radius_m, reach=False).select("cell", F.col("k").alias("key_a"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = cells(p, "y", "x", radius_m, reach=True).select("cell", F.col("k").alias("key_b"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    pairs = a.join(b, "cell").where(
        (F.col("key_a") < F.col("key_b"))
        & (F.abs(F.col("ya") - F.col("yb")) <= math.degrees(radius_m / EARTH_M) * 1.0001)
        & (haversine_m(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")) <= radius_m)
    )
    return pairs.select("key_a", "key_b").distinct()
