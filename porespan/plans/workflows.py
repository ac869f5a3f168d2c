"""Probability, critical loading, mixture design and conductivity, over independently seeded trials."""

from __future__ import annotations

import itertools
import math
import secrets
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from porespan.functions import stats
from porespan.operators import percolation as P
from porespan.operators import transport as T
from porespan.operators.contacts import POLICY
from porespan.policy import COST_TIES, MAX_GRID, DesignError, Domain, SetupError, axis_number, whole
from porespan.session import discard, materialize
from porespan.sources.particles import Population, generate, trial_keys, volume_fraction

#: Candidates of a mixture search that are evaluated in one pass.
BLOCK = 16


class TrialEvaluator(Protocol):
    """What decides trials: anything with a domain that turns particles into ``(realization_id, percolates)``.

    Realizations without particles have no rows here, and don't count as successes.
    """

    domain: Domain

    def outcomes(self, particles: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Evaluator:
    """Trials decided by an aggregate over the particles of a realization, such as ``F.count("*") >= 3``."""

    domain: Domain
    decide: Column

    def outcomes(self, particles: DataFrame) -> DataFrame:
        return particles.groupBy("realization_id").agg(F.coalesce(self.decide.cast("boolean"), F.lit(False)).alias("percolates"))


def make_evaluator(domain: Domain, decide: Column) -> Evaluator:
    return Evaluator(domain, decide)


@dataclass(frozen=True)
class Model:
    """What a trial decides: particles' contacts within the threshold, and whether they percolate along the axis."""

    domain: Domain
    threshold: float = 0.0
    axis: int | str = 0
    mode: str = "face_to_face"
    wrapped_parent: bool = False
    method: str = "cell_list"

    def outcomes(self, particles: DataFrame) -> DataFrame:
        found = P.analyze_percolation(particles, self.domain, self.threshold, self.axis, self.mode, self.wrapped_parent, self.method)
        return found.select("realization_id", "percolates")


Seed = int | Sequence[int] | np.random.SeedSequence | None
#: What a root stream is made from: an integer or several.
Entropy = int | tuple[int, ...]


def seed_of(seed: Seed) -> tuple[Entropy, tuple[int, ...]]:
    """(entropy, spawn key) of an integer, a sequence of integers, a seed sequence, or of fresh entropy."""
    if isinstance(seed, np.random.SeedSequence):
        if seed.pool_size != 4:
            raise SetupError("a seed sequence needs a pool of the usual size")
        entropy = seed.entropy
        return int(entropy) if isinstance(entropy, (int, np.integer)) else tuple(int(v) for v in entropy), tuple(int(k) for k in seed.spawn_key)
    if seed is None:
        return secrets.randbits(128), ()
    if isinstance(seed, (list, tuple, np.ndarray)):
        if not len(seed):
            raise SetupError("a seed needs at least one integer")
        return tuple(whole(v, "seed") for v in seed), ()
    return whole(seed, "seed"), ()


def seed_label(seed: tuple[Entropy, tuple[int, ...]]) -> str:
    """How results name a seed: its entropy, and the spawn key if there is one."""
    entropy, key = seed
    named = str(entropy) if isinstance(entropy, int) else ",".join(map(str, entropy))
    return named if not key else f"{named}/{','.join(map(str, key))}"


def _positive(n: int, name: str) -> int:
    return whole(n, name, 1)


def successes(spark: SparkSession, model: TrialEvaluator, populations: list[Population], trials: int, entropy: Entropy, prefix: tuple[int, ...] = ()) -> int:
    """Percolating trials of a design. Realizations without any particle don't percolate."""
    return design_successes(spark, model, populations, [[p.count for p in populations]], trials, entropy, [prefix])[0]


def design_successes(
    spark: SparkSession, model: TrialEvaluator, populations: list[Population], designs: list[list[int]], trials: int, entropy: Entropy, prefixes: list[tuple[int, ...]]
) -> list[int]:
    """Percolating trials of each design (counts of the populations), all in one pass; a design's prefix names its streams."""
    _positive(trials, "trials")
    keys = None
    for k, (counts, prefix) in enumerate(zip(designs, prefixes, strict=True)):
        if sum(counts):
            part = trial_keys(spark, trials, prefix).withColumn("realization_id", F.col("realization_id") + k * trials)
            part = part.withColumn("counts", F.array(*[F.lit(int(c)) for c in counts]))
            keys = part if keys is None else keys.unionByName(part)
    if keys is None:
        return [0] * len(designs)
    particles = materialize(generate(keys, model.domain, populations, entropy), "particles")
    found = model.outcomes(particles).where("percolates").groupBy(F.floor(F.col("realization_id") / trials).alias("k")).agg(F.count("*").alias("n"))
    hits = {r["k"]: r["n"] for r in found.collect()}  # a row a design
    discard(particles)
    return [hits.get(k, 0) for k in range(len(designs))]


def estimate(k: int, n: int, confidence: float) -> dict:
    low, high = stats.exact_interval(k, n, confidence)
    z_low, z_high = stats.wilson_interval(k, n, confidence)
    return {
        "successes": k, "trials": n, "probability": k / n, "standard_error": math.sqrt(k / n * (1 - k / n) / n), "wilson_low": z_low, "wilson_high": z_high, "exact_low": low, "exact_high": high,
        "lower_bound": stats.exact_interval(k, n, confidence, "lower")[0], "upper_bound": stats.exact_interval(k, n, confidence, "upper")[1], "confidence": confidence,
    }


def probability(spark: SparkSession, model: TrialEvaluator, populations: list[Population], trials: int = 1000, seed: Seed = None, confidence: float = 0.95) -> dict:
    entropy, key = seed_of(seed)
    return estimate(successes(spark, model, populations, trials, entropy, key), trials, confidence) | {"seed": seed_label((entropy, key))}


# ---------------------------------------------------------------- critical loading


def nested_successes(spark: SparkSession, model: TrialEvaluator, variable: Population, fixed: list[Population], grid: list[int], trials: int, entropy: Entropy, key: tuple[int, ...] = ()) -> list[int]:
    """Trials that percolate at each count of the grid; counts of a trial are prefixes of one realization.

    After a trial's first success greater counts are taken as successes. A ``Model``'s links, face to face or winding, are searched once and taken by age; other evaluators look at the counts one after the
    other, each at the trials that are still open.
    """
    top = [*fixed, variable.of(grid[-1])]
    base = sum(p.count for p in fixed)
    if not base + grid[-1]:
        return [0] * len(grid)
    particles = materialize(generate(trial_keys(spark, trials, (*key, 0)), model.domain, top, entropy), "particles")
    if isinstance(model, Model) and model.mode.replace("-", "_").lower() == "face_to_face":
        links = P.face_links(particles, model.domain, model.threshold, axis_number(model.axis), model.wrapped_parent, model.method, POLICY)
        first = P.nested_first_counts(links, [base + c for c in grid])
    elif isinstance(model, Model):
        k = axis_number(model.axis)
        first = P.nested_first_counts(P.winding_links(particles, model.domain, model.threshold, k, model.method, POLICY), [base + c for c in grid], k)
    else:
        first, done = None, []
        for g, count in enumerate(grid):
            rest = particles.where(F.col("idx") < base + count)
            rest = rest if first is None else rest.join(first, "realization_id", "left_anti")
            part = model.outcomes(rest).where("percolates").select("realization_id", F.lit(g).cast("long").alias("first"))
            done.append(materialize(part, "hits"))
            first = done[-1] if first is None else first.unionByName(done[-1])
    hits = {r["first"]: r["n"] for r in first.where("first is not null").groupBy("first").agg(F.count("*").alias("n")).collect()}
    return list(itertools.accumulate(hits.get(g, 0) for g in range(len(grid))))


def _critical(grid: list[int], hits: list[int], trials: int, certify: Callable[[list[int]], tuple[list[int], int]], target: float, confidence: float, strategy: str) -> dict:
    """The decision from the successes at each count of the grid; ``certify`` gives those of independent trials at one or two counts, and their number."""
    if strategy == "pava":
        fitted = stats.pava([k / trials for k in hits], [trials] * len(grid)).tolist()
    else:
        fitted = stats.fit_link(grid, hits, [trials] * len(grid), strategy)["fitted"]
    at = next((i for i, p in enumerate(fitted) if p >= target), None)
    certified = [grid[-1]] if at is None else [grid[0]] if at == 0 else grid[at - 1 : at + 1]
    level = stats.bonferroni(confidence, len(certified))
    again, n = certify(certified)
    rows = [estimate(k, n, level) | {"count": c} for k, c in zip(again, certified, strict=True)]
    if at is None:
        status = "NO_CROSSING" if rows[-1]["upper_bound"] < target else "INCONCLUSIVE"
    else:
        status = "CERTIFIED" if rows[-1]["lower_bound"] >= target and (at == 0 or rows[0]["upper_bound"] < target) else "INCONCLUSIVE"
    search = [estimate(k, trials, confidence) | {"count": c, "fitted": p} for c, k, p in zip(grid, hits, fitted, strict=True)]
    return {"status": status, "critical_count": None if at is None else grid[at], "target": target, "confidence": confidence, "per_comparison": level, "strategy": strategy, "search": search, "certification": rows}


def _checked_grid(grid: Iterable[int], target: float, confidence: float) -> list[int]:
    grid = list(grid)
    if not grid or len(grid) > MAX_GRID or any(b <= a for a, b in zip(grid, grid[1:], strict=False)) or grid[0] < 0:
        raise SetupError("the grid must rise strictly")
    if not 0 < target < 1 or not 0 < confidence < 1:
        raise SetupError("target and confidence must lie between 0 and 1")
    return grid


def critical_loading(
    spark: SparkSession, model: TrialEvaluator, variable: Population, grid: list[int], fixed: list[Population] = (), target: float = 0.9, search_trials: int = 1000, certification_trials: int = 5000,
    confidence: float = 0.95, strategy: str = "pava", seed: Seed = None,
) -> dict:
    """The least count that reaches the target: a search, and certification with independent trials."""
    grid, fixed = _checked_grid(grid, target, confidence), list(fixed)
    entropy, key = seed_of(seed)
    hits = nested_successes(spark, model, variable, fixed, grid, _positive(search_trials, "search_trials"), entropy, key)

    def certify(counts: list[int]) -> tuple[list[int], int]:
        designs = [[*(p.count for p in fixed), c] for c in counts]
        return design_successes(spark, model, [*fixed, variable], designs, certification_trials, entropy, [(*key, 1, b) for b in range(len(counts))]), certification_trials

    found = _critical(grid, hits, search_trials, certify, target, confidence, strategy)
    count = found["critical_count"]
    return found | {"volume_fraction": None if count is None else volume_fraction([*fixed, variable.of(count)], model.domain), "seed": seed_label((entropy, key))}


def critical_prefix(search: DataFrame, certification: DataFrame, model: Model, grid: list[int], target: float = 0.9, confidence: float = 0.95, strategy: str = "pava") -> dict:
    """The same decision for trials that are given as tables of particles: the least number of a realization's first particles that reaches the target.

    Particles are numbered from 0 in each realization; ``certification`` holds other realizations than ``search``. Both are read as whole tables, one pass each.
    """
    grid = _checked_grid(grid, target, confidence)
    axis = axis_number(model.axis)

    def successes_at(particles: DataFrame, counts: list[int]) -> tuple[list[int], int]:
        particles = materialize(particles, "trials")
        if model.mode.replace("-", "_").lower() == "face_to_face":
            first = P.nested_first_counts(P.face_links(particles, model.domain, model.threshold, axis, model.wrapped_parent, model.method, POLICY), counts)
        else:
            first = P.nested_first_counts(P.winding_links(particles, model.domain, model.threshold, axis, model.method, POLICY), counts, axis)
        hits = {r["first"]: r["n"] for r in first.groupBy("first").agg(F.count("*").alias("n")).collect()}
        discard(particles)
        return list(itertools.accumulate(hits.get(g, 0) for g in range(len(counts)))), sum(hits.values())

    hits, trials = successes_at(search, grid)
    return _critical(grid, hits, _positive(trials, "realizations"), lambda counts: successes_at(certification, counts), target, confidence, strategy)


def probabilities(particles: DataFrame, model: TrialEvaluator, groups: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """``keys, successes, trials, probability, wilson_low, wilson_high``: how many of the realizations ``groups (realization_id, keys)`` percolate. Those without particles don't."""
    found = groups.join(model.outcomes(particles), "realization_id", "left")
    rows = found.groupBy(*keys).agg(F.count_if("percolates").alias("successes"), F.count("*").alias("trials"))
    low, high = stats.wilson(F.col("successes"), F.col("trials"), confidence)
    return rows.withColumns({"probability": F.col("successes") / F.col("trials"), "wilson_low": low, "wilson_high": high})


# ---------------------------------------------------------------- mixture design


def candidates(spark: SparkSession, populations: list[Population], bounds: list[tuple[int, int]], max_candidates: int = 100_000) -> DataFrame:
    """``(counts, cost)`` of every mixture within the bounds, cheapest first; the number is checked before any is made."""
    n = math.prod(hi - lo + 1 for lo, hi in bounds)
    if len(bounds) != len(populations) or any(lo < 0 or hi < lo for lo, hi in bounds):
        raise SetupError("each population needs bounds low <= high")
    if n > max_candidates:
        raise DesignError(f"{n} candidates exceed {max_candidates}")
    out = spark.range(1).select()
    for k, (lo, hi) in enumerate(bounds):
        out = out.crossJoin(spark.range(lo, hi + 1).toDF(f"c{k}"))
    cost = sum((F.col(f"c{k}") * F.lit(float(p.volume * p.cost_per_volume)) for k, p in enumerate(populations)), F.lit(0.0))
    return out.select(F.array(*[f"c{k}" for k in range(len(bounds))]).alias("counts"), cost.alias("cost")).orderBy("cost", "counts")


@dataclass
class _Phase:
    rows: list[dict] = field(default_factory=list)
    limit: float | None = None

    def beyond(self, cost: float) -> bool:
        return self.limit is not None and cost > self.limit + COST_TIES * max(abs(cost), abs(self.limit))


def optimize_mixture(
    spark: SparkSession, model: TrialEvaluator, populations: list[Population], bounds: list[tuple[int, int]], target: float = 0.9, screening_trials: int = 250, certification_trials: int = 5000,
    confidence: float = 0.95, max_candidates: int = 100_000, seed: Seed = None, evaluate=None, block: int = BLOCK,
) -> dict:
    """The cheapest mixture that reaches the target; every interval holds at once over both phases of all candidates.

    Candidates are evaluated cheapest first, ``block`` at a time in one pass; those of a block that lie beyond the stop are dropped again, so
    decisions don't depend on the block. ``evaluate(counts, trials, prefix)`` may give the successes instead.
    """
    entropy, key = seed_of(seed)
    designs = [(list(r["counts"]), r["cost"]) for r in candidates(spark, populations, bounds, max_candidates).collect()]
    level = stats.bonferroni(confidence, 2 * len(designs))

    def run(part: list[tuple[int, list[int]]], trials: int, branch: int) -> list[int]:
        prefixes = [(*key, branch, m) for m, _ in part]
        if evaluate:
            return [evaluate(counts, trials, prefix) for (_, counts), prefix in zip(part, prefixes, strict=True)]
        return design_successes(spark, model, populations, [counts for _, counts in part], trials, entropy, prefixes)

    phases = []
    for branch, trials, conf, passes in ((0, screening_trials, confidence, "probability"), (1, certification_trials, level, "lower_bound")):
        phase, size, at = _Phase(), 1 if evaluate else block, 0
        while at < len(designs) and not phase.beyond(designs[at][1]):
            part = [(m, designs[m][0]) for m in range(at, min(at + size, len(designs))) if not phase.beyond(designs[m][1])]
            for (m, counts), k in zip(part, run(part, trials, branch), strict=True):
                cost = designs[m][1]
                if phase.beyond(cost):
                    break
                row = estimate(k, trials, conf) | {"counts": counts, "cost": cost}
                phase.rows.append(row)
                if phase.limit is None and row[passes] >= target:
                    phase.limit = cost
            at += size
        phases.append(phase)
    screening, certification = (p.rows for p in phases)
    good = [r for r in certification if r["lower_bound"] >= target]
    if good:
        pick = min(good, key=lambda r: (r["cost"], r["counts"]))
        cheaper = [r for r in certification if r["cost"] < pick["cost"] - COST_TIES * max(abs(r["cost"]), abs(pick["cost"]))]
        status = "CERTIFIED_OPTIMAL" if all(r["upper_bound"] < target for r in cheaper) else "INCONCLUSIVE"
    else:
        pick, status = next((r for r in screening if r["probability"] >= target), None), "NO_CERTIFIED_FEASIBLE"
    return {"status": status, "counts": pick and pick["counts"], "cost": pick and pick["cost"], "target": target, "per_comparison": level, "comparisons": 2 * len(designs), "evaluated": max(len(screening), len(certification)), "screening": screening, "certification": certification, "seed": seed_label((entropy, key))}


# ---------------------------------------------------------------- conductivity


def conductivity_samples(spark: SparkSession, domain: Domain, populations: list[Population], law: T.Law, axes: tuple = ("x", "y", "z"), trials: int = 100, seed: Seed = None, electrode_law: T.Law | None = None, voltage: float = 1.0) -> DataFrame:
    """``realization_id, axis, sigma``; all axes of a trial share its particles."""
    entropy, key = seed_of(seed)
    particles = materialize(generate(trial_keys(spark, trials, key), domain, populations, entropy), "particles")
    return T.conductivity(particles, domain, law, axes, electrode_law, voltage).select("realization_id", "axis", "sigma")


def summarize(sigmas: DataFrame, samples: bool = True) -> DataFrame:
    """Mean, standard error (null for one trial) and conducting trials by axis; with ``samples`` the samples in order of their trial.

    The samples of an axis are one array, as large as its trials; leave them out where these don't fit a row.
    """
    columns = [F.avg("sigma").alias("mean"), (F.stddev_samp("sigma") / F.sqrt(F.count("*"))).alias("standard_error"), F.count_if(F.col("sigma") > 0).alias("conducting"), F.count("*").alias("trials"), F.max(F.abs("sigma")).alias("greatest")]
    if samples:
        columns.append(F.transform(F.sort_array(F.collect_list(F.struct("realization_id", "sigma"))), lambda s: s["sigma"]).alias("samples"))
    return sigmas.groupBy("axis").agg(*columns)
