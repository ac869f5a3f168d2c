"""Closed-form geometry as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from porespan.policy import Domain

Vector = tuple[Column, Column, Column]
AXES = ("x", "y", "z")


def norm(v: Vector) -> Column:
    return F.hypot(F.hypot(v[0], v[1]), v[2])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def unit(v: Vector) -> Vector:
    """Scaled by its greatest component first, so that no square over- or underflows; null for the zero vector."""
    top = F.greatest(*(F.abs(x) for x in v))
    top = F.when(top > 0, top)
    w = tuple(x / top for x in v)
    return tuple(x / norm(w) for x in w)


# ---------------------------------------------------------------- gaps between bodies, 0 where they overlap


def sphere_sphere(a: Vector, ra: Column, b: Vector, rb: Column) -> Column:
    return positive(norm(minus(a, b)) - ra - rb)


def point_cylinder(p: Vector, c: Vector, u: Vector, length: Column, radius: Column) -> Column:
    d = minus(p, c)
    return F.hypot(positive(F.abs(dot(d, u)) - length / 2), positive(norm(cross(d, u)) - radius))


def sphere_cylinder(p: Vector, r: Column, c: Vector, u: Vector, length: Column, radius: Column) -> Column:
    return positive(point_cylinder(p, c, u, length, radius) - r)


def parallel_cylinders(a: Vector, la: Column, ra: Column, b: Vector, lb: Column, rb: Column, u: Vector) -> Column:
    d = minus(a, b)
    return F.hypot(positive(F.abs(dot(d, u)) - (la + lb) / 2), positive(norm(cross(d, u)) - ra - rb))


def point_rectangle(p: Vector, c: Vector, half: Vector) -> Column:
    return norm(tuple(positive(F.abs(x - y) - e) for x, y, e in zip(p, c, half, strict=True)))


def sphere_rectangle(p: Vector, r: Column, c: Vector, half: Vector) -> Column:
    return positive(point_rectangle(p, c, half) - r)


def point_segment(p: Vector, a: Vector, b: Vector) -> Column:
    ab, ap = minus(b, a), minus(p, a)
    t = F.least(F.lit(1.0), positive(dot(ap, ab) / F.greatest(dot(ab, ab), F.lit(1e-300))))
    return norm(tuple(x - t * y for x, y in zip(ap, ab, strict=True)))


def segment_segment(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Distance of the segments a - b and c - d: the least of the ends' distances to the other segment, and of the lines where both nearest points lie inside."""
    u, v, w = minus(b, a), minus(d, c), minus(a, c)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    safe = F.when(det > F.lit(1e-14) * uu * vv, det)  # null for parallel or degenerate ones: an end is nearest there
    s, t = (uv * vw - vv * uw) / safe, (uu * vw - uv * uw) / safe
    inside = F.coalesce((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), F.lit(False))
    lines = norm(tuple(x + s * y - t * z for x, y, z in zip(w, u, v, strict=True)))
    ends = F.least(point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b))
    return F.when(inside, F.least(lines, ends)).otherwise(ends)


def segment_meets_box(a: Vector, b: Vector, center: Vector, half: Vector) -> Column:
    """Whether a segment and a box have a point in common: the ranges in which it lies between each pair of faces overlap."""
    first, last = F.lit(0.0), F.lit(1.0)
    out = F.lit(True)
    for x, y, c, h in zip(a, b, center, half, strict=True):
        step = y - x
        still = step == 0
        one, two = (c - h - x) / F.when(~still, step), (c + h - x) / F.when(~still, step)
        first = F.greatest(first, F.least(one, two))  # nulls don't count
        last = F.least(last, F.greatest(one, two))
        out = out & (~still | (F.abs(x - c) <= h))
    return out & (first <= last)


def endpoints(c: Vector, u: Vector, length: Column) -> tuple[Vector, Vector]:
    """The ends of a cylinder's axis."""
    return tuple(x - length / 2 * y for x, y in zip(c, u, strict=True)), tuple(x + length / 2 * y for x, y in zip(c, u, strict=True))


def from_endpoints(a: Vector, b: Vector) -> tuple[Vector, Vector, Column]:
    """(centre, axis, length) of a cylinder between two points."""
    d = minus(b, a)
    return tuple(x / 2 + y / 2 for x, y in zip(a, b, strict=True)), unit(d), norm(d)


def moved(c: Vector, by: Vector) -> Vector:
    return tuple(x + y for x, y in zip(c, by, strict=True))


def plane_basis(n: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors that are orthogonal to a unit vector and to each other."""
    small = [F.abs(x) for x in n]
    least = F.when((small[0] <= small[1]) & (small[0] <= small[2]), F.lit(0)).when(small[1] <= small[2], F.lit(1)).otherwise(F.lit(2))
    e = tuple(F.when(least == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(3))
    first = unit(cross(n, e))
    return first, cross(n, first)


def extent(is_sphere: Column, u: Vector, length: Column, radius: Column, axis: int) -> Column:
    """Half the width of a body's bounding box."""
    other = [u[k] for k in range(3) if k != axis]
    return F.when(is_sphere, radius).otherwise(length / 2 * F.abs(u[axis]) + radius * F.hypot(*other))


# ---------------------------------------------------------------- periodic boxes


def canonical_shift(x: Column, domain: Domain, axis: int) -> Column:
    """The lattice steps that bring a coordinate into the base cell; raises where they leave exact integers."""
    if not domain.periodic[axis]:
        return F.lit(0).cast("long")
    q = (x - F.lit(domain.lower[axis])) / F.lit(domain.size[axis])
    return F.when(F.abs(q) < 2.0**53, -F.floor(q)).otherwise(F.raise_error(F.lit("lattice step beyond exact integers")).cast("long"))


def wrap(x: Column, domain: Domain, axis: int) -> Column:
    """The coordinate in the half-open base cell; round-off at the upper bound goes to the lower one."""
    if not domain.periodic[axis]:
        return x
    moved = x + canonical_shift(x, domain, axis) * F.lit(domain.size[axis])
    lo, hi = F.lit(domain.lower[axis]), F.lit(domain.upper[axis])
    return F.when((moved < lo) | (moved >= hi), lo).otherwise(moved)


def exact_cell_floor(x: Column, domain: Domain, axis: int) -> Column:
    """The cell that holds a coordinate, as a decimal of any number of digits up to 38: beyond doubles' exact integers, and next to a border, by exact decimals.

    Doubles are taken at their shortest decimal form there.
    """
    size, lower = F.lit(domain.size[axis]), F.lit(domain.lower[axis])
    q = (x - lower) / size
    close = F.abs(q - F.round(q)) <= 16 * F.lit(2.0**-52) * F.greatest(F.abs(q), F.lit(1.0))
    wide = "decimal(38,12)"
    exact = F.floor((x.cast(wide) - lower.cast(wide)) / size.cast(wide)).cast("decimal(38,0)")
    return F.when(close | (F.abs(q) >= 2.0**53), exact).otherwise(F.floor(q).cast("decimal(38,0)"))


def minimum_image(d: Column, domain: Domain, axis: int) -> Column:
    """The nearest image of a difference; half a cell gives minus half a cell."""
    if not domain.periodic[axis]:
        return d
    size = F.lit(domain.size[axis])
    return d - F.floor(d / size + F.lit(0.5)) * size


# ---------------------------------------------------------------- volumes, cost and conductance laws


def sphere_volume(r: Column) -> Column:
    return F.lit(4.0) / 3 * F.pi() * F.pow(r, F.lit(3.0))


def cylinder_volume(r: Column, length: Column) -> Column:
    return F.pi() * r * r * length


def safe_product(*factors: Column) -> Column:
    """A product of positive numbers, mantissas and powers of two apart; raises only where the value itself is beyond the doubles, or below the least one."""
    mantissa, power = F.lit(1.0), F.lit(0.0)
    for f in factors:
        e = F.floor(F.log2(f))
        mantissa, power = mantissa * (f / F.pow(F.lit(2.0), F.floor(e / 2)) / F.pow(F.lit(2.0), e - F.floor(e / 2))), power + e
    half = F.floor(power / 2)
    value = mantissa * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    return F.when((value > 0) & (value < float("inf")), value).when(value.isNotNull(), F.raise_error(F.lit("a product is beyond the range of doubles")).cast("double"))


def count_for_fraction(fraction: Column, volume: Column, domain_volume: float, rounding: str = "half_up") -> Column:
    raw = fraction * F.lit(domain_volume) / volume
    return {"half_up": F.round(raw), "ceil": F.ceil(raw), "floor": F.floor(raw)}[rounding].cast("long")


def constant_conductance(gap: Column, g0: float = 1.0, cutoff: float = 0.0) -> Column:
    return F.when(gap <= cutoff, F.lit(float(g0))).otherwise(F.lit(0.0))


def tunnelling_conductance(gap: Column, g0: float = 1.0, length: float = 0.1, cutoff: float = 1.0) -> Column:
    return F.when(gap <= cutoff, F.exp(F.log(F.lit(float(g0))) - 2 * (gap / F.lit(float(length))))).otherwise(F.lit(0.0))
