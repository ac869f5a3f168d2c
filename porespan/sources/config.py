"""Strict YAML configurations of the workflows: unknown and repeated keys, wrong types and non-finite numbers are errors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import yaml

from porespan.operators.transport import Law
from porespan.plans.workflows import Model, seed_of
from porespan.policy import Domain, SetupError, axis_number, real, whole
from porespan.sources.particles import Population

# The sections and their keys.
SECTIONS = {
    "domain": {"size", "periodic", "center"},
    "percolation": {"threshold", "axis", "mode", "search", "wrapped_parent"},
    "simulation": {"trials", "seed", "confidence"},
    "critical": {"variable", "min_count", "max_count", "grid", "target", "search_trials", "certification_trials", "confidence", "strategy", "seed"},
    "optimization": {"bounds", "target", "screening_trials", "certification_trials", "confidence", "max_candidates", "seed"},
    "conductivity": {"axes", "trials", "seed", "voltage", "law", "electrode_law"},
    "benchmark": {"counts", "repeats", "warmup", "seed"},
}
PARTICLE = {"name", "shape", "radius", "length", "count", "cost_per_volume"}
LAW = {"type", "conductance", "cutoff", "decay_length"}


class _Loader(yaml.SafeLoader):
    """Refuses repeated and unhashable keys at every depth."""

    def construct_mapping(self, node, deep=False):
        seen = set()
        for key, _ in node.value:
            k = self.construct_object(key, deep=True)
            try:
                again = k in seen
            except TypeError as e:
                raise SetupError("a key is not a scalar") from e
            if again:
                raise SetupError(f"{k!r} is given twice")
            seen.add(k)
        return super().construct_mapping(node, deep)


def _known(section: dict, keys: set[str], name: str) -> dict:
    if not isinstance(section, dict):
        raise SetupError(f"{name} must be a mapping")
    if more := set(section) - keys:
        raise SetupError(f"{name} has unknown keys {sorted(map(str, more))}")
    return section


def _finite(value, name: str) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise SetupError(f"{name} has a number that is not finite")
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        _finite(v, f"{name}.{k}")


_number = real


def _law(section: dict, name: str) -> Law:
    s = _known(section, LAW, name)
    kind = s.get("type", "constant")
    if kind not in ("constant", "tunnelling"):
        raise SetupError(f"{name}.type must be constant or tunnelling")
    if kind == "tunnelling" and not {"cutoff", "decay_length"} <= set(s):
        raise SetupError(f"{name} needs cutoff and decay_length")
    return Law(_number(s.get("conductance", 1.0), name), _number(s.get("cutoff", 0.0), name), _number(s["decay_length"], name) if kind == "tunnelling" else None)


# The types of the sections' values. A list holds one type.
TYPES = {
    "percolation": {"threshold": "number", "axis": "axis", "mode": "text", "search": "text", "wrapped_parent": "flag"},
    "simulation": {"trials": "count", "seed": "seed", "confidence": "share"},
    "critical": {
        "variable": "text", "min_count": "count", "max_count": "count", "grid": ["count"], "target": "share", "search_trials": "count", "certification_trials": "count", "confidence": "share", "strategy": "text", "seed": "seed",
    },
    "optimization": {"target": "share", "screening_trials": "count", "certification_trials": "count", "confidence": "share", "max_candidates": "count", "seed": "seed"},
    "conductivity": {"axes": ["axis"], "trials": "count", "seed": "seed", "voltage": "number"},
    "benchmark": {"counts": ["count"], "repeats": "count", "warmup": "count", "seed": "seed"},
}


def _typed(value, kind, name: str):
    """``value`` as the kind says, or an error that names it."""
    if isinstance(kind, list):
        if not isinstance(value, list) or not value:
            raise SetupError(f"{name} must be a list with entries")
        return [_typed(v, kind[0], f"{name}[{k}]") for k, v in enumerate(value)]
    if kind == "text" and isinstance(value, str):
        return value
    if kind == "flag" and isinstance(value, bool):
        return value
    if kind == "axis":
        axis_number(value)
        return value
    if kind == "number":
        return _number(value, name)
    if kind == "share":
        if not 0 < (share := _number(value, name)) < 1:
            raise SetupError(f"{name} must lie between 0 and 1")
        return share
    if kind == "seed":
        if value is None:
            return value
        if isinstance(value, (int, list)):
            seed_of(value)
            return value
        if isinstance(value, dict) and set(value) == {"entropy", "spawn_key"} and isinstance(value["spawn_key"], list):
            parts = [value["entropy"], *value["spawn_key"]]
            if all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in parts):
                return np.random.SeedSequence(value["entropy"], spawn_key=tuple(value["spawn_key"]))
        raise SetupError(f"{name} must be a non-negative integer, a list of them, or a mapping of entropy and spawn_key")
    if kind == "count" and isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return value
    raise SetupError(f"{name} must be a {kind}")


@dataclass
class Config:
    model: Model
    populations: list[Population]
    simulation: dict = field(default_factory=dict)
    critical: dict = field(default_factory=dict)
    optimization: dict = field(default_factory=dict)
    conductivity: dict = field(default_factory=dict)
    benchmark: dict = field(default_factory=dict)

    def named(self, name: str) -> Population:
        for p in self.populations:
            if p.name == name:
                return p
        raise SetupError(f"no particle is named {name!r}")

    def validate_for(self, operation: str | None) -> None:
        wrap = self.model.mode.replace("-", "_").lower() != "face_to_face"
        if wrap and not self.model.domain.periodic[axis_number(self.model.axis)]:
            raise SetupError("winding needs a periodic axis")
        if operation == "conductivity" and (wrap or self.model.wrapped_parent):
            raise SetupError("conductivity is measured face to face")
        if operation == "optimize" and set(self.optimization.get("bounds", {})) != {p.name for p in self.populations}:
            raise SetupError("bounds must name every particle")
        if operation == "critical":
            if "variable" not in self.critical:
                raise SetupError("critical.variable is missing")
            self.named(self.critical["variable"])
            low, high = self.critical.get("min_count"), self.critical.get("max_count")
            if not self.critical.get("grid") and (low is None or high is None or high < low):
                raise SetupError("critical needs a grid, or min_count and max_count")


def loads_config(text: str, operation: str | None = None) -> Config:
    try:
        raw = yaml.load(text, Loader=_Loader)  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        raise SetupError(f"not valid YAML: {e}") from e
    raw = _known(raw, {"schema_version", "particles", *SECTIONS}, "configuration")
    if type(raw.get("schema_version")) is not int or raw["schema_version"] != 1:
        raise SetupError("schema_version must be 1")
    _finite(raw, "configuration")
    parts = {name: _known(raw.get(name) or {}, keys, name) for name, keys in SECTIONS.items()}
    for section, kinds in TYPES.items():
        parts[section] |= {k: _typed(v, kinds[k], f"{section}.{k}") for k, v in parts[section].items() if k in kinds}
    for section in SECTIONS:
        if raw.get(section) is not None and not isinstance(raw[section], dict):
            raise SetupError(f"{section} must be a mapping")
    bounds = parts["optimization"].get("bounds", {})
    if not isinstance(bounds, dict):
        raise SetupError("optimization.bounds must be a mapping of names to two counts")
    for name, pair in bounds.items():
        if not isinstance(pair, list) or len(pair) != 2 or any(isinstance(v, bool) or not isinstance(v, int) for v in pair) or not 0 <= pair[0] <= pair[1]:
            raise SetupError(f"optimization.bounds.{name} must be two counts, the lower one first")
    if "size" not in parts["domain"]:
        raise SetupError("domain.size is missing")
    domain = Domain(**{k: tuple(v) if isinstance(v, list) else v for k, v in parts["domain"].items()})
    populations, particles = [], raw.get("particles", [])
    if not isinstance(particles, list):
        raise SetupError("particles must be a list")
    for k, p in enumerate(particles):
        p = _known(p, PARTICLE, f"particles[{k}]")
        if p.get("shape", "sphere") not in ("sphere", "cylinder") or (p.get("shape") == "cylinder") != ("length" in p):
            raise SetupError(f"particles[{k}] must be a sphere, or a cylinder with a length")
        count, name = whole(p.get("count", 0), f"particles[{k}].count"), p.get("name")
        if name is not None and not isinstance(name, str):
            raise SetupError(f"particles[{k}].name must be text")
        populations.append(Population(_number(p.get("radius"), "radius"), count, _number(p["length"], "length") if "length" in p else None, _number(p.get("cost_per_volume", 0.0), "cost"), (name or "").strip() or None))
    q = parts["percolation"]
    model = Model(domain, _number(q.get("threshold", 0.0), "threshold"), q.get("axis", 0), q.get("mode", "face_to_face"), q.get("wrapped_parent", False), q.get("search", "cell_list"))
    for name in ("law", "electrode_law"):
        if name in parts["conductivity"]:
            parts["conductivity"][name] = _law(parts["conductivity"][name], name)
    out = Config(model, populations, *(parts[k] for k in ("simulation", "critical", "optimization", "conductivity", "benchmark")))
    out.validate_for(operation)
    return out


def load_config(path: str, operation: str | None = None) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return loads_config(f.read(), operation)
    except OSError as e:
        raise SetupError(f"can't read {path}: {e}") from e
