"""Commands: simulate, conductivity, critical, optimize, validate, benchmark. Exit 1: a failed validation, 2: an expected error."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from porespan.operators.contacts import find_contacts, search_counters
from porespan.operators.transport import Law
from porespan.plans import workflows as W
from porespan.policy import Domain, PorespanError
from porespan.session import spark_session
from porespan.sources.config import Config, load_config
from porespan.sources.particles import Population, generate, trial_keys
from porespan.sources.results import dumps, write_json
from porespan.validate import checks


def simulate(spark, c: Config) -> dict:
    return W.probability(spark, c.model, c.populations, **c.simulation)


def critical(spark, c: Config) -> dict:
    s = dict(c.critical)
    variable = c.named(s.pop("variable"))
    low, high = s.pop("min_count", None), s.pop("max_count", None)
    grid = s.pop("grid", None) or list(range(low, high + 1))
    return W.critical_loading(spark, c.model, variable, grid, [p for p in c.populations if p is not variable], **s)


def optimize(spark, c: Config) -> dict:
    s = dict(c.optimization)
    bounds = s.pop("bounds")
    return W.optimize_mixture(spark, c.model, c.populations, [tuple(bounds[p.name]) for p in c.populations], **s)


def conductivity(spark, c: Config) -> list[dict]:
    s = dict(c.conductivity)
    samples = W.conductivity_samples(spark, c.model.domain, c.populations, s.pop("law", Law()), tuple(s.pop("axes", ("x", "y", "z"))), **s)
    return [r.asDict() for r in W.summarize(samples).drop("greatest").orderBy("axis").collect()]


def benchmark(spark, c: Config | None) -> list[dict]:
    """Median and quartiles of the seconds of both contact joins by number of particles, and what they compare."""
    domain, p, threshold, b = (c.model.domain, c.populations[0], c.model.threshold, c.benchmark) if c else (Domain(50.0, True), Population(0.5, 0), 0.2, {})
    rows = []
    for n in b.get("counts", [10, 50, 100, 500, 1000]):
        particles = generate(trial_keys(spark, 1), domain, [p.of(n)], b.get("seed", 42)).persist()
        for method in ("bruteforce", "cell_list"):
            took = []
            for _ in range(b.get("warmup", 1) + b.get("repeats", 5)):
                t = time.perf_counter()
                found = find_contacts(particles, domain, threshold, method).count()
                took.append(time.perf_counter() - t)
            counts = search_counters(particles, domain, threshold, method).drop("realization_id").first()
            q = spark.createDataFrame([(x,) for x in took[b.get("warmup", 1) :]], "s double").agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
            rows.append({"count": n, "method": method, "contacts": found, **({} if counts is None else {k: counts[k] for k in ("candidates", "boxes", "evaluations")}), "q1": q[0], "median": q[1], "q3": q[2]})
    return rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="porespan")
    parser.add_argument("--version", action="version", version="porespan 0.1")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("simulate", "conductivity", "critical", "optimize", "validate", "benchmark"):
        sub = commands.add_parser(name)
        if name != "validate":
            sub.add_argument("config", nargs="?" if name == "benchmark" else None)
        sub.add_argument("--output")
    args = parser.parse_args(argv)
    try:
        config = load_config(args.config, args.command) if getattr(args, "config", None) else None
        spark = spark_session("porespan")
        result = checks(spark) if args.command == "validate" else globals()[args.command](spark, config)
        if args.output:
            write_json(result, args.output)
        else:
            sys.stdout.write(dumps(result))
    except (PorespanError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return int(args.command == "validate" and not all(r["passed"] for r in result))


if __name__ == "__main__":
    sys.exit(main())
