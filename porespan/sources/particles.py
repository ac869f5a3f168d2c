"""Particle tables: schema, readers with checks, views over generic tables, and seeded generation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespan.functions import geometry as G
from porespan.functions.sums import exact_sums
from porespan.policy import Domain, SetupError, real, whole

SCHEMA = (
    "realization_id long, idx int, shape string, cx double, cy double, cz double, ux double, uy double, uz double, length double, radius double, parent_id string, ox long, oy long, oz long"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Population:
    """Some spheres (length None) or cylinders of one size; cost is by volume."""

    radius: float
    count: int
    length: float | None = None
    cost_per_volume: float = 0.0
    name: str | None = None

    def __post_init__(self):
        whole(self.count, "count")
        if real(self.radius, "radius") <= 0 or (self.length is not None and real(self.length, "length") <= 0) or real(self.cost_per_volume, "cost_per_volume") < 0:
            raise SetupError("sizes must be positive, costs not negative")

    @property
    def volume(self) -> float:
        return 4 / 3 * np.pi * self.radius**3 if self.length is None else np.pi * self.radius**2 * self.length

    def of(self, count: int) -> Population:
        return Population(self.radius, count, self.length, self.cost_per_volume, self.name)


def populations_of(specs: Population | Sequence[Population], counts: int | Sequence[int]) -> list[Population]:
    """Populations of the given bodies (whose own counts don't matter) and numbers of them."""
    specs = [specs] if isinstance(specs, Population) else list(specs)
    counts = [counts] if isinstance(counts, (int, np.integer)) else list(counts)
    if not specs or len(specs) != len(counts):
        raise SetupError("as many bodies as counts are needed, and at least one")
    return [p.of(whole(n, f"counts[{k}]")) for k, (p, n) in enumerate(zip(specs, counts, strict=True))]


def volume_fraction(populations: list[Population], domain: Domain) -> float:
    """Overlaps are not subtracted; the sum is exact and rounded once."""
    total = sum((p.count * Fraction(p.volume) for p in populations), Fraction(0)) / math.prod(map(Fraction, domain.size))
    try:
        return float(total)
    except OverflowError as e:
        raise SetupError("the volume fraction is beyond the range of doubles") from e


def total_volumes(particles: DataFrame, domain: Domain, keys: tuple[str, ...] = ("realization_id",)) -> DataFrame:
    """``volume`` and ``fraction`` of the bodies of each key, overlaps not subtracted: sums rounded once, whatever the order of rows."""
    body = F.when(F.col("shape") == "sphere", G.sphere_volume(F.col("radius"))).otherwise(G.cylinder_volume(F.col("radius"), F.col("length")))
    return exact_sums(particles, list(keys), {"volume": body}).withColumn("fraction", F.col("volume") / F.lit(domain.volume))


def checked(particles: DataFrame) -> DataFrame:
    """Completes missing columns, normalises axes, and raises at the first row that is no body."""
    for c in COLUMNS:
        if c not in particles.columns:
            kind = dict(x.split() for x in SCHEMA.split(", "))[c]
            start = F.lit(0) if c == "realization_id" else F.lit("sphere") if c == "shape" else F.lit(None)
            particles = particles.withColumn(c, start.cast(kind))
    finite = F.lit(True)
    for c in ("cx", "cy", "cz", "radius"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    body = finite & (F.col("radius") > 0) & ((F.col("shape") == "sphere") | ((F.col("shape") == "cylinder") & (F.col("length") > 0) & (F.greatest(*(F.abs(c) for c in ("ux", "uy", "uz"))) > 0)))
    out = particles.where(F.when(~F.coalesce(body, F.lit(False)), F.raise_error(F.lit("not a sphere or cylinder of finite size")).cast("boolean")).otherwise(F.lit(True)))
    u = G.unit(tuple(F.col(c) for c in ("ux", "uy", "uz")))
    return out.withColumns({c: F.when(F.col("shape") == "cylinder", v) for c, v in zip(("ux", "uy", "uz"), u, strict=True)}).select(*COLUMNS)


def read_particles(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Particles from parquet, json, csv or orc with the schema above; extra columns are not read."""
    reader = spark.read.format(kind)
    if kind in ("json", "csv"):
        reader = reader.schema(SCHEMA)
    return checked(reader.option("header", "true").load(path) if kind == "csv" else reader.load(path))


def embedding_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres at 20 times the first three coordinates of each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.col("embedding")[k].cast("double") * 20.0
    rows = e.select(F.col("vec_id").cast("int").alias("idx"), at(0).alias("cx"), at(1).alias("cy"), at(2).alias("cz"), (0.5 + 0.1 * (F.col("label") % 4)).alias("radius"), F.col("label").cast("string").alias("group"))
    return checked(rows.drop("group"))


# ---------------------------------------------------------------- seeded generation


def generated(rng: np.random.Generator, domain: Domain, populations: list[Population]) -> dict[str, np.ndarray]:
    """Centres, then axes of cylinders, population by population."""
    centers, axes, lengths, radii = [], [], [], []
    for p in populations:
        centers.append(rng.uniform(domain.lower, domain.upper, (p.count, 3)))
        u = np.full((p.count, 3), np.nan)
        if p.length is not None:
            u = rng.normal(size=(p.count, 3))
            while (zero := np.linalg.norm(u, axis=1) == 0).any():
                u[zero] = rng.normal(size=(int(zero.sum()), 3))
            u = u / np.linalg.norm(u, axis=1)[:, None]
        axes.append(u)
        lengths.append(np.full(p.count, np.nan if p.length is None else p.length))
        radii.append(np.full(p.count, p.radius))
    return {"c": np.concatenate(centers), "u": np.concatenate(axes), "length": np.concatenate(lengths), "radius": np.concatenate(radii)}


def _frame(rid: int, g: dict[str, np.ndarray]) -> pd.DataFrame:
    n = len(g["radius"])
    frame = {"realization_id": np.full(n, rid), "idx": np.arange(n, dtype=np.int32), "shape": np.where(np.isnan(g["length"]), "sphere", "cylinder")}
    frame |= {f"c{a}": g["c"][:, k] for k, a in enumerate("xyz")} | {f"u{a}": g["u"][:, k] for k, a in enumerate("xyz")}
    frame |= {"length": g["length"], "radius": g["radius"], "parent_id": [str(i) for i in range(n)]}
    return pd.DataFrame(frame | {c: pd.array([None] * n, "Int64") for c in ("ox", "oy", "oz")})


def generate(trials: DataFrame, domain: Domain, populations: list[Population], entropy: int | Sequence[int]) -> DataFrame:
    """Particles of every row ``(realization_id, spawn_key array<long>)``; a key names its own random stream.

    A column ``counts array<int>`` gives a row its own numbers of particles of the populations.
    """
    own = "counts" in trials.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, key, counts in zip(batch["realization_id"], batch["spawn_key"], batch["counts"] if own else [None] * len(batch), strict=True):
                rng = np.random.default_rng(np.random.SeedSequence(entropy, spawn_key=tuple(int(k) for k in key)))
                g = generated(rng, domain, populations if counts is None else [p.of(int(c)) for p, c in zip(populations, counts, strict=True)])
                yield _frame(rid, g)

    rows = trials.select("realization_id", "spawn_key", *(["counts"] if own else [])).mapInPandas(run, SCHEMA)
    return _bare_spheres(rows)


def _bare_spheres(rows: DataFrame) -> DataFrame:
    """Spheres without axis and length."""
    return rows.withColumns({c: F.when(F.col("shape") == "cylinder", F.col(c)) for c in ("ux", "uy", "uz", "length")})


def microstructure(spark: SparkSession, domain: Domain, populations: list[Population], seed: int | Sequence[int] | np.random.SeedSequence | None = None, rng: np.random.Generator | None = None) -> DataFrame:
    """Particles of one realization from a seed, which a task draws from, or from a generator that the caller holds (then they are drawn here)."""
    if rng is not None and seed is not None:
        raise SetupError("a generator or a seed, not both")
    if rng is None:
        root = seed if isinstance(seed, np.random.SeedSequence) else np.random.SeedSequence(seed)
        key = spark.range(1).select(F.col("id").alias("realization_id"), F.array(*[F.lit(int(k)).cast("long") for k in root.spawn_key]).cast("array<long>").alias("spawn_key"))
        return generate(key, domain, populations, root.entropy)
    return _bare_spheres(spark.createDataFrame(_frame(0, generated(rng, domain, populations)), SCHEMA))


def trial_keys(spark: SparkSession, trials: int, prefix: tuple[int, ...] = ()) -> DataFrame:
    """``(realization_id, spawn_key)``: the children of a seed's branch."""
    parts = max(1, min(trials, spark.sparkContext.defaultParallelism))
    keys = spark.range(0, trials, 1, parts).withColumnRenamed("id", "realization_id")
    return keys.withColumn("spawn_key", F.array(*[F.lit(int(p)).cast("long") for p in prefix], F.col("realization_id")))
