"""The package's functions for SQL: ``register(spark)`` makes them temporary functions of a session.

Gaps, wrapping and laws are SQL functions, so they are planned like any expression; ``lattice_images`` is a table function that a lateral
join calls for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from porespan.policy import MAX_IMAGES

#: Name, arguments, type and body of each SQL function.
SQL_FUNCTIONS = [
    ("lattice_step", "x double, lower double, size double", "bigint", "if(abs((x - lower) / size) < 9007199254740992D, -floor((x - lower) / size), raise_error('lattice step beyond exact integers'))"),
    ("wrapped", "x double, lower double, size double", "double", "if(x + lattice_step(x, lower, size) * size < lower or x + lattice_step(x, lower, size) * size >= lower + size, lower, x + lattice_step(x, lower, size) * size)"),
    ("minimum_image", "d double, size double", "double", "d - floor(d / size + 0.5D) * size"),
    ("distance3", "ax double, ay double, az double, bx double, b_y double, bz double", "double", "hypot(hypot(ax - bx, ay - b_y), az - bz)"),
    ("sphere_gap", "ax double, ay double, az double, ra double, bx double, b_y double, bz double, rb double", "double", "greatest(distance3(ax, ay, az, bx, b_y, bz) - ra - rb, 0D)"),
    ("sphere_volume", "r double", "double", "4D / 3D * pi() * r * r * r"),
    ("cylinder_volume", "r double, length double", "double", "pi() * r * r * length"),
    ("cylinder_extent", "along double, length double, radius double", "double", "length / 2D * abs(along) + radius * sqrt(greatest(1D - along * along, 0D))"),
    ("contact_tolerance", "scale double", "double", "greatest(1e-9D, 1e-12D * greatest(scale, 1D))"),
    ("tunnelling_conductance", "gap double, g0 double, length double, cutoff double", "double", "if(gap <= cutoff, exp(ln(g0) - 2D * (gap / length)), 0D)"),
]


@udtf(returnType=T.StructType([T.StructField(f"k{a}", T.LongType()) for a in "xyz"]))
class LatticeImages:
    """Steps of all images of a box (centre c, half width e, by axis) that reach into the base cell widened by pad; an open axis has size null and no steps."""

    def eval(self, cx: float, ex: float, lx: float, sx: float | None, cy: float, ey: float, ly: float, sy: float | None, cz: float, ez: float, lz: float, sz: float | None, pad: float) -> Iterator[tuple[int, int, int]]:
        import math

        spans = []
        for c, e, low, size in ((cx, ex, lx, sx), (cy, ey, ly, sy), (cz, ez, lz, sz)):
            if size is None:
                spans.append(range(1))
            else:
                first, last = math.ceil((low - pad - c - e) / size), math.floor((low + size + pad - c + e) / size)
                spans.append(range(first, last + 1))
        if len(spans[0]) * len(spans[1]) * len(spans[2]) > MAX_IMAGES:
            raise ValueError("too many lattice images")
        for kx in spans[0]:
            for ky in spans[1]:
                for kz in spans[2]:
                    yield kx, ky, kz


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    for name, arguments, kind, body in SQL_FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")
    spark.udtf.register("lattice_images", LatticeImages)
    return [f[0] for f in SQL_FUNCTIONS] + ["lattice_images"]
