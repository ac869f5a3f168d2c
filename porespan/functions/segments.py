"""Exact decisions about segments: floating formulas with a bound of their error, and rational arithmetic for the rows that the bound leaves open.

``segment_gaps`` and ``segment_box_hits`` add a column each. Rows whose decisions (which ends are nearest, whether lines cross inside, whether ranges overlap) are
farther from a tie than round-off can carry them keep the JVM's value; nearly parallel, touching and degenerate ones are decided with fractions in
Arrow batches, and ``exact`` says which ones were.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespan.functions import geometry as G

#: Round-off of the formulas, in units of the products that they add up: some dozens of operations of 2 ** -53 each.
ROUND_OFF = 2.0**-44


def _dot(a: list[Fraction], b: list[Fraction]) -> Fraction:
    return sum((x * y for x, y in zip(a, b, strict=True)), Fraction(0))


def _minus(a: list[Fraction], b: list[Fraction]) -> list[Fraction]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _to_segment(p: list[Fraction], a: list[Fraction], b: list[Fraction]) -> Fraction:
    """The squared distance of a point and a segment."""
    ab, ap = _minus(b, a), _minus(p, a)
    size = _dot(ab, ab)
    t = min(Fraction(1), max(Fraction(0), _dot(ap, ab) / size)) if size else Fraction(0)
    rest = [x - t * y for x, y in zip(ap, ab, strict=True)]
    return _dot(rest, rest)


def rational_distance(*v: float) -> float:
    """The distance of the segments v[0:3] - v[3:6] and v[6:9] - v[9:12], rounded once and its root once more."""
    x = [Fraction(c) for c in v]
    a, b, c, d = x[0:3], x[3:6], x[6:9], x[9:12]
    best = min(_to_segment(a, c, d), _to_segment(b, c, d), _to_segment(c, a, b), _to_segment(d, a, b))
    u, w, r = _minus(b, a), _minus(d, c), _minus(a, c)
    uu, uw, ww, ur, wr = _dot(u, u), _dot(u, w), _dot(w, w), _dot(u, r), _dot(w, r)
    det = uu * ww - uw * uw
    if det:
        s, t = (uw * wr - ww * ur) / det, (uu * wr - uw * ur) / det
        if 0 <= s <= 1 and 0 <= t <= 1:
            rest = [p + s * q - t * z for p, q, z in zip(r, u, w, strict=True)]
            best = min(best, _dot(rest, rest))
    k = (best.numerator.bit_length() - best.denominator.bit_length()) // 2
    near_one = best / Fraction(4) ** k
    return math.ldexp(math.sqrt(near_one.numerator / near_one.denominator), k)


def rational_hit(*v: float) -> bool:
    """Whether the segment v[0:3] - v[3:6] and the box of centre v[6:9] and half widths v[9:12] have a point in common."""
    x = [Fraction(c) for c in v]
    first, last = Fraction(0), Fraction(1)
    for a, b, c, h in zip(x[0:3], x[3:6], x[6:9], x[9:12], strict=True):
        if a == b:
            if abs(a - c) > h:
                return False
            continue
        one, two = (c - h - a) / (b - a), (c + h - a) / (b - a)
        first, last = max(first, min(one, two)), min(last, max(one, two))
    return first <= last


def _exactly(decide: Callable[..., float | bool], kind: T.DataType, arrow: pa.DataType) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else decide(*r) for r in rows.to_pylist()], arrow)

    return run


def _open_rows(df: DataFrame, name: str, close: Column, plain: Column, vectors: tuple[G.Vector, ...], decide: Callable, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """``df`` with ``name`` and ``exact``: ``plain`` but for the rows that are ``close``; for others nothing but a null goes to Python."""
    numbers = F.array(*[x.cast("double") for v in vectors for x in v])
    known = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    open_ = F.coalesce(close, F.lit(True)) & known
    return df.withColumn(name, F.coalesce(_exactly(decide, kind, arrow)(F.when(open_, numbers)), F.when(known, plain))).withColumn("exact", open_)


def segment_gaps(df: DataFrame, a: G.Vector, b: G.Vector, c: G.Vector, d: G.Vector, name: str = "gap") -> DataFrame:
    """``df`` with the distance of the segments a - b and c - d as ``name`` and whether it was decided exactly as ``exact``. Null or not finite ends give null."""
    u, w, r = G.minus(b, a), G.minus(d, c), G.minus(a, c)
    uu, uw, ww, ur, wr = G.dot(u, u), G.dot(u, w), G.dot(w, w), G.dot(u, r), G.dot(w, r)
    det, far = uu * ww - uw * uw, G.norm(r) + F.sqrt(uu) + F.sqrt(ww)
    # round-off of both numerators, whose terms are products of four lengths, and of the determinant
    noise = F.lit(ROUND_OFF) * F.sqrt(uu) * F.sqrt(ww) * far * F.greatest(F.sqrt(uu), F.sqrt(ww))
    s, t = uw * wr - ww * ur, uu * wr - uw * ur
    near = lambda x: (F.abs(x) <= noise) | (F.abs(x - det) <= noise + F.lit(ROUND_OFF) * uu * ww)
    close = (det <= F.lit(2.0**-20) * uu * ww) | near(s) | near(t)
    return _open_rows(df, name, close, G.segment_segment(a, b, c, d), (a, b, c, d), rational_distance, T.DoubleType(), pa.float64())


def segment_box_hits(df: DataFrame, a: G.Vector, b: G.Vector, center: G.Vector, half: G.Vector, name: str = "meets") -> DataFrame:
    """``df`` with whether the segment a - b meets the box as ``name`` and whether it was decided exactly as ``exact``. Null or not finite numbers give null."""
    firsts, lasts, close = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for x, y, c, h in zip(a, b, center, half, strict=True):
        step = y - x
        size = F.abs(x) + F.abs(y) + F.abs(c) + h
        # a step within round-off of its ends, or a still one on a face, is decided exactly
        close = close | ((step != 0) & (F.abs(step) <= F.lit(2.0**-20) * size)) | ((step == 0) & (F.abs(F.abs(x - c) - h) <= F.lit(ROUND_OFF) * size))
        one, two = (c - h - x) / F.when(step != 0, step), (c + h - x) / F.when(step != 0, step)
        firsts.append(F.least(one, two))
        lasts.append(F.greatest(one, two))
    first, last = F.greatest(*firsts), F.least(*lasts)
    close = close | (F.abs(first - last) <= F.lit(2.0**-22) * (1 + F.abs(first) + F.abs(last)))
    return _open_rows(df, name, close, G.segment_meets_box(a, b, center, half), (a, b, center, half), rational_hit, T.BooleanType(), pa.bool_())
