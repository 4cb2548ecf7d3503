"""Column kits for projections, frames and features (inventory B)."""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vector:
    return F.col(f"{prefix}x{suffix}"), F.col(f"{prefix}y{suffix}"), F.col(f"{prefix}z{suffix}")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vector, s: Column) -> Vector:
    return a[0] * s, a[1] * s, a[2] * s


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def unit(a: Vector, least: float = 1e-12) -> Vector:
    """a over its length; a shorter vector than `least` is an error."""
    n = norm(a)
    return scale(a, F.lit(1.0) / F.when(n >= least, n).otherwise(F.raise_error(F.lit("vector without length")).cast("double")))


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between directions."""
    return F.degrees(F.acos(clipped(dot(a, b) / (norm(a) * norm(b)))))


def axis_angle(a: Vector, b: Vector) -> Column:
    """Degrees between unsigned axes."""
    return F.degrees(F.acos(clipped(F.abs(dot(a, b)) / (norm(a) * norm(b)))))


def tangent_frame(normal: Vector, least: float = 0.15) -> tuple[Vector, Vector]:
    """Two unit vectors across a unit normal: the x axis projected off it, or the y axis where too little of x
    is left, and their cross product."""
    ex, ey = (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0), F.lit(0.0))
    off = lambda e: minus(e, scale(normal, dot(e, normal)))
    a, b = off(ex), off(ey)
    use = norm(a) >= least
    first = unit(tuple(F.when(use, p).otherwise(q) for p, q in zip(a, b, strict=True)))
    return first, cross(normal, first)


def to_local(p: Vector, origin: Vector, frame: tuple[Vector, Vector, Vector]) -> Vector:
    d = minus(p, origin)
    return dot(d, frame[0]), dot(d, frame[1]), dot(d, frame[2])


def spherical(p: Vector) -> tuple[Column, Column, Column]:
    """(r, theta from the z axis, phi)."""
    r = norm(p)
    return r, F.acos(clipped(p[2] / r)), F.atan2(p[1], p[0])


def gnomonic(v: Vector, middle: Vector, t1: Vector, t2: Vector) -> tuple[Column, Column]:
    """Central projection on the plane across `middle`; null where v points away."""
    m = dot(v, middle)
    ahead = F.when(m > 0, m)
    return dot(v, t1) / ahead, dot(v, t2) / ahead


def solid_angle(a: Vector, b: Vector, c: Vector) -> Column:
    """Of the triangle of three unit vectors."""
    return 2 * F.atan2(F.abs(dot(a, cross(b, c))), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def affine(p: Vector, centre: Vector, m: list[list[float]]) -> Vector:
    d = minus(p, centre)
    return tuple(c + sum((x * F.lit(float(w)) for x, w in zip(d, row, strict=True)), F.lit(0.0)) for c, row in zip(centre, m, strict=True))


def transformed_normal(n: Vector, inverse: list[list[float]]) -> Vector:
    """Normals transform by the inverse's transpose."""
    return unit(tuple(sum((x * F.lit(float(inverse[i][j])) for i, x in enumerate(n)), F.lit(0.0)) for j in range(3)))


def surface_normal(gy: Column, gz: Column) -> tuple[Vector, Column]:
    """Normal and slope of a height map by its gradient."""
    return unit((F.lit(1.0), -gy, -gz)), F.hypot(gy, gz)


def polynomial(cols: list[str], degree: int) -> dict[str, Column]:
    """All products up to a degree, with the constant first."""
    out = {"one": F.lit(1.0)}
    for d in range(1, degree + 1):
        for names in combinations_with_replacement(cols, d):
            product = F.lit(1.0)
            for n in names:
                product = product * F.col(n)
            out["_".join(names)] = product
    return out


def rbf_centres(steps: int = 7, reach: float = 0.8, limit: float = 1.05) -> list[tuple[float, float]]:
    grid = [reach * (2 * i / (steps - 1) - 1) for i in range(steps)]
    return [(a, b) for a in grid for b in grid if hypot(a, b) <= limit]


def rbf(u: Column, v: Column, sigma: float, centres: list[tuple[float, float]]) -> list[Column]:
    return [F.exp(-((u - a) * (u - a) + (v - b) * (v - b)) / (2 * sigma * sigma)) for a, b in centres]


def first_failure(rules: dict[str, Column]) -> Column:
    """The name of the first rule that fails (null counts as failing), or null."""
    whole = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        whole = F.when(bad, name) if whole is None else whole.when(bad, name)
    return whole


def region_masks(u: Column, v: Column) -> dict[str, Column]:
    return {
        "central_disk": u * u + v * v <= 0.25 * 0.25,
        "half_plane": u > 0,
        "quadrant": (u > 0) & (v > 0),
        "diagonal_band": F.abs(u - v) <= 0.2,
        "offset_disk": (u - 0.3) * (u - 0.3) + (v - 0.3) * (v - 0.3) <= 0.3 * 0.3,
    }


def quadrant(u: Column, v: Column, cu: Column, cv: Column) -> Column:
    return (u >= cu).cast("int") + 2 * (v >= cv).cast("int")


def quadrant_distance(u: Column, v: Column, cu: Column, cv: Column, block: Column) -> Column:
    """Distance of a point to a quadrant: the length of what it lacks along both axes."""
    su, sv = F.when(block % 2 == 1, 1).otherwise(-1), F.when(block >= 2, 1).otherwise(-1)
    lack = lambda d, s: F.greatest(-(d * s), F.lit(0.0))
    return F.hypot(lack(u - cu, su), lack(v - cv, sv))


def band(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below a value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def rescale_uint8(value: Column, lo: Column, hi: Column) -> Column:
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - lo) * 255.0 / (hi - lo)))).cast("int")


def canonical_grid(spark, limit: float, step: float) -> DataFrame:
    """Integer grid (gi, gj) with u, v = step * (gi, gj) inside a disk."""
    n = int(limit / step + 1e-9)
    g = spark.range(1).select(F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("gi")).select("gi", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("gj"))
    g = g.select("gi", "gj", (F.col("gi") * step).alias("u"), (F.col("gj") * step).alias("v"))
    return g.where(F.col("u") * F.col("u") + F.col("v") * F.col("v") <= limit * limit + 1e-12)


def neighbour_list(text: Column) -> Column:
    """"[3 5 9]" as an array of integers."""
    inner = F.trim(F.regexp_replace(text, r"[\[\],]", " "))
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, r"\s+").cast("array<int>"))


def angular_bounds(span: Column, most: int = 20) -> Column:
    """For each bound b from 0 on: the least and the largest true span."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda b: F.struct(b.alias("bound"), F.greatest(F.lit(0.0), span - 2 * b).alias("low"), F.least(F.lit(180.0), span + 2 * b).alias("high")))


def overlap_measures(overlap: Column, a: Column, b: Column, duplicate: float = 0.5) -> dict[str, Column]:
    small = overlap / F.least(a, b)
    return {"iou": overlap / (a + b - overlap), "of_smaller": small, "duplicate": small >= duplicate}
