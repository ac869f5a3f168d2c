"""Intervals, isotonic fits and link fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespan.policy import SetupError
from porespan.session import discard, materialize


def bonferroni(confidence: float, comparisons: int) -> float:
    """The confidence of each of some comparisons."""
    level = 1 - (1 - confidence) / comparisons
    if not 0 < level < 1:
        raise SetupError("confidence can't be shared among so many comparisons")
    return level


def _wilson(k, n, confidence: float, root: Callable) -> tuple:
    """Both ends of the interval, for columns or numbers."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, zz = k / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z / (1 + zz / n) * root(p * (1 - p) / n + zz / (4 * n * n))
    return middle - half, middle + half


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    low, high = _wilson(k, n, confidence, F.sqrt)
    return F.when(k == 0, F.lit(0.0)).otherwise(low), F.when(k == n, F.lit(1.0)).otherwise(high)


def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``q1, median, q3`` of a column by keys, between neighbours where they fall between rows."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))])


# ---------------------------------------------------------------- beta quantiles


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the incomplete beta's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def wilson_interval(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    low, high = _wilson(k, n, confidence, math.sqrt)
    return 0.0 if k == 0 else low, 1.0 if k == n else high


def exact_interval(k: int, n: int, confidence: float = 0.95, side: str = "two") -> tuple[float, float]:
    """Clopper-Pearson; ``side`` two, lower or upper."""
    if not 0 <= k <= n or n < 1:
        raise SetupError("successes must lie within the trials")
    tail = (1 - confidence) / (2 if side == "two" else 1)
    low = 0.0 if k == 0 or side == "upper" else beta_quantile(tail, k, n - k + 1)
    high = 1.0 if k == n or side == "lower" else beta_quantile(1 - tail, k + 1, n - k)
    return low, high


def clopper_pearson(confidence: float = 0.95):
    """A vectorised function of (successes, trials) columns."""

    @F.pandas_udf("low double, high double")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        pairs = {p: exact_interval(*p, confidence) for p in set(zip(k.astype(int), n.astype(int), strict=True))}
        return pd.DataFrame([pairs[p] for p in zip(k.astype(int), n.astype(int), strict=True)], columns=["low", "high"])

    return run


# ---------------------------------------------------------------- isotonic regression


def pava(value: list[float], weight: list[float] | None = None) -> np.ndarray:
    """Non-decreasing weighted least squares over a grid."""
    weight = np.ones(len(value)) if weight is None else np.asarray(weight, float) / max(weight)
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + n]
    return np.repeat([s / w for s, w, _ in blocks], [int(n) for *_, n in blocks])


def _lower_hull(x: list[float], y: list[float]) -> list[int]:
    """Indices of the vertices of the greatest convex function below points of ascending x."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (y[b] - y[a]) * (x[i] - x[b]) < (y[i] - y[b]) * (x[b] - x[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


class _Bridges:
    """The greatest convex minorant of many convex chains that follow each other, from few of their vertices.

    A chain is a range's own minorant of the cumulative diagram (weight, sum). Known vertices give a hull; what a gap between two known neighbours hides lies
    in the triangle of their chord and the chain's slopes there. Gaps whose triangle reaches below the hull, and those at the ends of
    edges between chains (the common tangents), are asked for; all others keep their chains as they are.
    """

    def __init__(self, chains: Iterable[int]):
        self.known: dict[int, dict[int, tuple[float, ...]]] = {c: {} for c in chains}

    def add(self, chain: int, index: int, x: float, y: float, left: float, right: float) -> None:
        """A vertex with the chain's slopes before and after it."""
        self.known[chain][index] = (x, y, left, right)

    def hull(self) -> list[tuple[int, int]]:
        """(chain, index) of the known vertices on the hull; ``self.flat`` has all known ones and ``self.kept`` the hull's places in it."""
        self.flat = [(c, i, *v) for c in sorted(self.known) for i, v in sorted(self.known[c].items())]
        self.kept = _lower_hull([v[2] for v in self.flat], [v[3] for v in self.flat])
        return [self.flat[k][:2] for k in self.kept]

    def open_gaps(self) -> list[tuple[int, int, int]]:
        """(chain, first, last) of gaps that may change the hull."""
        self.hull()
        on, out = set(self.kept), []
        hx, hy = (np.array([self.flat[k][c] for k in self.kept]) for c in (2, 3))
        bridge_ends = {k for a, b in zip(self.kept, self.kept[1:], strict=False) if self.flat[a][0] != self.flat[b][0] or b != a + 1 for k in (a, b)}
        for k in range(len(self.flat) - 1):
            (c, i, x, y, _, s), (d, j, u, v, t, _) = self.flat[k], self.flat[k + 1]
            if c != d or j == i + 1:
                continue
            if k in on and k + 1 in on:
                if k in bridge_ends or k + 1 in bridge_ends:
                    out.append((c, i, j))
                continue
            apex = (v - y + s * x - t * u) / (s - t) if s < t else x
            apex = min(max(apex, x), u)
            if y + s * (apex - x) <= np.interp(apex, hx, hy) + 1e-12 * (abs(y) + abs(v) + 1):
                out.append((c, i, j))
        return out

    def tangents(self) -> list[tuple[int, int, int, int]]:
        """(chain, index, chain, index) of the hull's edges from a chain to a later one."""
        names = self.hull()
        return [(*a, *b) for a, b in zip(names, names[1:], strict=False) if a[0] != b[0]]


#: Vertices of a range that one round asks for in a gap.
VERTICES = 256


def isotonic(points: DataFrame, order: str, value: str, weight: str, parts: int = 64) -> DataFrame:
    """``points`` (one for each value of ``order``) with ``fitted``, the non-decreasing weighted least-squares fit.

    Ranges of the order are pooled on their own; their pools are convex chains of the cumulative diagram. Only vertices near the common tangents of chains are looked
    at, some hundred a range and round, so no task holds more than a range, however many pools there are. Points under a common tangent
    are one pool; all others keep the pool of their range. Weights are positive; an empty table gives an empty result.
    """
    ranged = points.select(F.struct("*").alias("row"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    ranged = ranged.repartitionByRange(parts, "o").sortWithinPartitions("o").select("row", "v", "w")
    schema = T.StructType([ranged.schema["row"], *(T.StructField(n, T.LongType()) for n in ("part", "pool")), *(T.StructField(n, T.DoubleType()) for n in ("v", "w", "s", "t", "before_s", "before_t", "previous", "next"))])

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        v, w = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("v", "w"))
        blocks: list[list] = []
        for x, y in zip((v * w).tolist(), w.tolist(), strict=True):
            n = 1
            while blocks and blocks[-1][1] * y >= x * blocks[-1][2]:
                m, s, t = blocks.pop()
                n, x, y = n + m, s + x, t + y
            blocks.append([n, x, y])
        n, s, t = map(np.array, zip(*blocks, strict=True))
        slope = np.r_[-np.inf, s / t, np.inf]
        table = {"s": s, "t": t, "before_s": np.cumsum(s) - s, "before_t": np.cumsum(t) - t, "previous": slope[:-2], "next": slope[2:]}
        pool, lo = np.repeat(np.arange(len(n)), n), 0
        for b in held:
            mine = pool[lo : lo + len(b)]
            lo += len(b)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(np.full(len(b), TaskContext.get().partitionId())), pa.array(mine), b["v"], b["w"], *(pa.array(x[mine]) for x in table.values())], schema.names)

    local = materialize(ranged.mapInArrow(pooled, schema), "pools")
    ends = local.groupBy("part").agg(F.max("pool").alias("last"), F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("t")).orderBy("part").collect()  # a row a range
    sizes = {r.part: r.last + 1 for r in ends}
    start_s = dict(zip(sizes, np.cumsum([0.0, *(r.s for r in ends)])[:-1], strict=False))
    start_t = dict(zip(sizes, np.cumsum([0.0, *(r.t for r in ends)])[:-1], strict=False))
    bridges, asked = _Bridges(sizes), [(c, -1, n) for c, n in sizes.items()]
    vertices = local.groupBy("part", "pool").agg(*[F.first(c).alias(c) for c in ("s", "t", "before_s", "before_t", "previous", "next")])
    spark = points.sparkSession
    while asked:
        gaps = [(c, i, j, max(1, (j - i) // VERTICES)) for c, i, j in asked]
        wanted = F.broadcast(spark.createDataFrame(gaps, "part long, lo long, hi long, step long"))
        near = (F.col("pool") > F.col("lo")) & (F.col("pool") < F.col("hi")) & (((F.col("pool") - F.col("lo") - 1) % F.col("step") == 0) | (F.col("pool") == F.col("hi") - 1))
        for r in vertices.join(wanted, "part").where(near).collect():  # some hundred a gap
            x, y = start_t[r.part] + r.before_t, start_s[r.part] + r.before_s
            # a pool is the edge from its vertex to the next one
            bridges.add(r.part, r.pool, x, y, r.previous, r.s / r.t)
            if r.pool + 1 < sizes[r.part] or r.part == ends[-1].part:  # a chain's last vertex is the next one's first
                bridges.add(r.part, r.pool + 1, x + r.t, y + r.s, r.s / r.t, r.next)
        asked = [g for g in bridges.open_gaps() if g[2] - g[1] > 1]
    cut = [(k, *t) for k, t in enumerate(bridges.tangents())]
    edges = F.broadcast(spark.createDataFrame(cut, "bridge long, c long, i long, d long, j long"))
    under = (F.struct(F.col("part"), F.col("pool")) >= F.struct(F.col("c"), F.col("i"))) & (F.struct(F.col("part"), F.col("pool")) < F.struct(F.col("d"), F.col("j")))
    placed = local.join(edges, under, "left").select("row", "s", "t", "v", "w", "bridge")
    level = placed.where("bridge is not null").groupBy("bridge").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("level"))
    out = placed.join(F.broadcast(level), "bridge", "left")  # at most a bridge for each two ranges
    return out.select("row.*", F.coalesce("level", F.col("s") / F.col("t")).alias("fitted"))


# ---------------------------------------------------------------- link fits


def fit_link(x: list[float], successes: list[int], trials: list[int], link: str = "logistic", rounds: int = 200) -> dict:
    """Binomial maximum likelihood of intercept and slope >= 0 on standardised x, probabilities clipped at 1e-14.

    Separable data have no finite maximum: the slope is bounded, and ``converged`` says false.
    """
    x, k, n = (np.asarray(v, float) for v in (x, successes, trials))
    center, scale = x.mean(), x.std() or 1.0
    z = (x - center) / scale
    normal = NormalDist()
    if link == "logistic":
        cdf = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
        pdf = lambda t: cdf(t) * (1 - cdf(t))
    elif link == "probit":
        cdf = lambda t: np.array([normal.cdf(v) for v in t])
        pdf = lambda t: np.array([normal.pdf(v) for v in t])
    else:
        raise SetupError("link must be logistic or probit")

    def likelihood(w: np.ndarray) -> float:
        p = np.clip(cdf(w[0] + w[1] * z), 1e-14, 1 - 1e-14)
        return float(k @ np.log(p) + (n - k) @ np.log1p(-p))

    w, best, converged = np.array([0.0, 1.0]), -np.inf, False
    for _ in range(rounds):
        t = w[0] + w[1] * z
        p, d = np.clip(cdf(t), 1e-14, 1 - 1e-14), np.maximum(pdf(t), 1e-300)
        score, info = d * (k - n * p) / (p * (1 - p)), n * d * d / (p * (1 - p))
        g, h = np.array([score.sum(), (score * z).sum()]), np.array([[info.sum(), (info * z).sum()], [(info * z).sum(), (info * z * z).sum()]])
        move, size = np.linalg.solve(h + 1e-12 * np.eye(2), g), 1.0
        here = likelihood(w)
        while size > 1e-10:
            trial = np.array([w[0] + size * move[0], min(max(w[1] + size * move[1], 0.0), 200.0)])
            if likelihood(trial) >= here:
                break
            size /= 2
        else:
            converged = True
            break
        change, w, best = np.abs(trial - w).max(), trial, likelihood(trial)
        if change < 1e-10:
            converged = 0 < w[1] < 200
            break
    best = likelihood(w)
    return {"link": link, "intercept": float(w[0]), "slope": float(w[1]), "log_likelihood": best, "aic": 4 - 2 * best, "bic": 2 * math.log(n.sum()) - 2 * best, "converged": bool(converged), "x_center": float(center), "x_scale": float(scale), "fitted": cdf(w[0] + w[1] * z).tolist()}


@F.arrow_udf(T.DoubleType())
def _normal(x: pa.Array) -> pa.Array:
    return pa.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.to_pylist()], pa.float64())


def fit_links(points: DataFrame, keys: list[str], x: str, successes: str, trials: str, link: str = "logistic", rounds: int = 100) -> DataFrame:
    """A row for each value of ``keys``: ``intercept, slope, x_center, x_scale, log_likelihood, trials, converged``, the fit of ``fit_link`` for all keys at once.

    A round is one grouped aggregate: likelihood, score and information at every key's next point. Keys whose likelihood fell halve their step, others
    take the next Newton step; keys that have settled leave. Rows of equal x are added up first. Keys with one x have no slope and don't converge.
    """
    if link not in ("logistic", "probit"):
        raise SetupError("link must be logistic or probit")
    names, keys = keys, [f"__key{i}" for i in range(len(keys))]  # so that any names of keys will do
    rows = points.groupBy(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], F.col(x).cast("double").alias("x")).agg(F.sum(F.col(successes).cast("double")).alias("k"), F.sum(F.col(trials).cast("double")).alias("n"))
    rows = materialize(rows, "points")
    sizes = rows.groupBy(*keys).agg(F.avg("x").alias("center"), F.stddev_pop("x").alias("scale"), F.sum("n").alias("trials"))
    zero, one = F.lit(0.0), F.lit(1.0)
    state = sizes.withColumns({"scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(one), "w0": zero, "w1": one, "best": F.lit(float("-inf")), "d0": zero, "d1": zero, "size": one, "done": F.lit(False), "converged": F.lit(False)})
    state = materialize(state, "state")
    kept = state.columns
    for _ in range(rounds):
        going = state.where("not done")
        if not going.limit(1).count():
            break
        at = going.withColumns({"c0": F.col("w0") + F.col("size") * F.col("d0"), "c1": F.least(F.greatest(F.col("w1") + F.col("size") * F.col("d1"), zero), F.lit(200.0))})
        held = rows.join(at.select(*keys, "center", "scale", "c0", "c1"), keys).withColumn("z", (F.col("x") - F.col("center")) / F.col("scale"))
        held = held.withColumn("t", F.col("c0") + F.col("c1") * F.col("z"))
        if link == "logistic":
            held = held.withColumn("f", 1 / (1 + F.exp(-F.greatest(F.least("t", F.lit(40.0)), F.lit(-40.0))))).withColumn("d", F.col("f") * (1 - F.col("f")))
        else:
            held = held.withColumn("f", _normal("t")).withColumn("d", F.exp(-F.col("t") * F.col("t") / 2) / math.sqrt(2 * math.pi))
        p, d, n, k, z = F.col("p"), F.greatest(F.col("d"), F.lit(1e-300)), F.col("n"), F.col("k"), F.col("z")
        held = held.withColumn("p", F.least(F.greatest(F.col("f"), F.lit(1e-14)), F.lit(1 - 1e-14)))
        score, info = d * (k - n * p) / (p * (1 - p)), n * d * d / (p * (1 - p))
        sums = {"now": k * F.log(p) + (n - k) * F.log1p(-p), "g0": score, "g1": score * z, "h00": info, "h01": info * z, "h11": info * z * z}
        found = held.groupBy(*keys).agg(*[F.sum(v).alias(c) for c, v in sums.items()])
        at = at.join(found, keys)
        better = F.col("now") >= F.col("best") - F.coalesce(F.when(F.col("best") > float("-inf"), 1e-13 * F.abs("best")), zero)  # but for round-off
        det = (F.col("h00") + 1e-12) * (F.col("h11") + 1e-12) - F.col("h01") * F.col("h01")
        n0, n1 = ((F.col("h11") + 1e-12) * F.col("g0") - F.col("h01") * F.col("g1")) / det, ((F.col("h00") + 1e-12) * F.col("g1") - F.col("h01") * F.col("g0")) / det
        still = better & (F.col("best") > float("-inf")) & (F.greatest(F.abs(F.col("c0") - F.col("w0")), F.abs(F.col("c1") - F.col("w1"))) < 1e-10)
        spent = ~better & (F.col("size") <= 1e-10)
        new = at.select(
            *keys, "center", "scale", "trials", *[F.when(better, F.col(c)).otherwise(F.col(w)).alias(w) for c, w in (("c0", "w0"), ("c1", "w1"), ("now", "best"))],
            F.when(better, n0).otherwise(F.col("d0")).alias("d0"), F.when(better, n1).otherwise(F.col("d1")).alias("d1"), F.when(better, one).otherwise(F.col("size") / 2).alias("size"),
            (still | spent).alias("done"), F.when(still, (F.col("c1") > 0) & (F.col("c1") < 200)).otherwise(spent).alias("converged"),
        )
        before, state = state, materialize(new.select(*kept).unionByName(state.where("done")), "state")
        discard(before)
    return state.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], F.col("w0").alias("intercept"), F.col("w1").alias("slope"), F.col("center").alias("x_center"), F.col("scale").alias("x_scale"), F.col("best").alias("log_likelihood"), "trials", "converged")


def link_predict(model: dict, x: list[float]) -> list[float]:
    """Fitted probabilities at ``x``."""
    t = (np.asarray(x, float) - model["x_center"]) / model["x_scale"] * model["slope"] + model["intercept"]
    if model["link"] == "logistic":
        return (1 / (1 + np.exp(-np.clip(t, -700, 700)))).tolist()
    return [NormalDist().cdf(v) for v in t]


def link_threshold(model: dict, probability: float) -> float:
    if model["slope"] <= 0:
        raise SetupError("a flat curve has no threshold")
    t = math.log(probability / (1 - probability)) if model["link"] == "logistic" else NormalDist().inv_cdf(probability)
    return model["x_center"] + model["x_scale"] * (t - model["intercept"]) / model["slope"]
