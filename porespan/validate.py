"""Built-in checks of an installation: closed forms, known circuits and intervals, and two ways to the same contacts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession

from porespan.functions import convex, stats
from porespan.operators import contacts as C
from porespan.operators import percolation as P
from porespan.operators import transport as T
from porespan.policy import Domain
from porespan.sources.particles import Population, checked, generate, trial_keys


def _spheres(spark: SparkSession, xs: list[float], radius: float = 1.0):
    rows = [(i, "sphere", float(x), 0.0, 0.0, radius) for i, x in enumerate(xs)]
    return checked(spark.createDataFrame(rows, "idx int, shape string, cx double, cy double, cz double, radius double"))


def checks(spark: SparkSession) -> list[dict]:
    found = []

    def check(name: str, passed: bool, detail: str) -> None:
        found.append({"name": name, "passed": bool(passed), "detail": detail})

    up, one = np.array([[0.0, 0.0, 1.0]]), np.array([1.0])
    gap = convex.cylinder_gaps(np.zeros((1, 3)), up, 2 * one, 0.5 * one, np.array([[2.0, 0.0, 3.5]]), up, 2 * one, 0.5 * one)[0]
    check("parallel cylinders", abs(gap - math.hypot(1, 1.5)) < 1e-7, f"{gap:.12g}")
    low, high = stats.exact_interval(4, 100)
    check("exact interval", abs(low - 0.011004493986188201) < 1e-12 and abs(high - 0.09925715671265992) < 1e-12, f"{low}, {high}")
    check("isotonic", np.allclose(stats.pava([0, 1, 0], [1, 1, 2]), [0, 1 / 3, 1 / 3]), "0, 1/3, 1/3")
    r = T.solve_network(3, np.array([0, 1]), np.array([1, 2]), np.array([2.0, 3.0]), 0, 2, 5.0)
    check("series circuit", abs(r["conductance"] - 1.2) < 1e-12 and abs(r["power"] - 30) < 1e-10, str(r["voltages"]))
    chain = P.analyze_percolation(_spheres(spark, [-4, -2, 0, 2, 4]), Domain(10.0)).first()
    check("chain", chain["percolates"] and list(chain["path"]) == [0, 1, 2, 3, 4], str(chain["path"]))
    broken = P.analyze_percolation(_spheres(spark, [-4, -2, 2, 4]), Domain(10.0)).first()
    check("broken chain", not broken["percolates"] and broken["n_components"] == 2, str(broken["n_components"]))
    loop = P.analyze_percolation(_spheres(spark, [-4, 0, 4]), Domain(10.0, True), 2.0, 0, "periodic_wrap").first()
    check("winding", loop["percolates"] and loop["winding"][0] == 1, str(loop["winding"]))
    mixed = generate(trial_keys(spark, 2), Domain(6.0, (True, False, True)), [Population(0.5, 20), Population(0.3, 10, 1.5)], 5)
    d = Domain(6.0, (True, False, True))
    a, b = (x.select("realization_id", "i", "j", "sx", "sy", "sz") for x in (C.cell_contacts(mixed, d, 0.2), C.theta_contacts(mixed, d, 0.2)))
    differ = a.exceptAll(b).count() + b.exceptAll(a).count()
    check("contact parity", differ == 0, f"{differ} differ")
    return found
