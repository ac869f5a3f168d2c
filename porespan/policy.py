"""Tolerances, guards and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IMAGES, MAX_GRID, COST_TIES = 1_000_000, 100_000, 64 * 2.0**-52


class PorespanError(Exception):
    """Any expected error of this package."""


class ShapeError(PorespanError, ValueError):
    pass


class SetupError(PorespanError, ValueError):
    pass


class TrialError(PorespanError):
    pass


class DesignError(PorespanError):
    pass


@dataclass(frozen=True)
class Policy:
    """A value is close to a limit within ``max(absolute, relative * max(scale, 1))``."""

    absolute: float = 1e-9
    relative: float = 1e-12

    def tolerance(self, scale: float) -> float:
        return max(self.absolute, self.relative * max(scale, 1.0))

    def tolerance_of(self, *scales: Column) -> Column:
        scale = F.greatest(*scales, F.lit(1.0)) if scales else F.lit(1.0)
        return F.greatest(F.lit(self.absolute), F.lit(self.relative) * scale)


def real(value: object, name: str) -> float:
    """A finite number as a float; booleans, text and nothing are none."""
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, (int, float, np.integer, np.floating)):
        raise SetupError(f"{name} must be a number, not {value!r}")
    try:
        number = float(value)
    except OverflowError as e:
        raise SetupError(f"{name} is too large") from e
    if not math.isfinite(number):
        raise SetupError(f"{name} must be finite")
    return number


def whole(value: object, name: str, least: int = 0) -> int:
    """An integer of at least ``least``; booleans are none."""
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, (int, np.integer)) or value < least:
        raise SetupError(f"{name} must be an integer of at least {least}, not {value!r}")
    return int(value)


@dataclass(frozen=True)
class Domain:
    """An orthorhombic box; each axis may be periodic."""

    size: tuple[float, float, float]
    periodic: tuple[bool, bool, bool] = (False, False, False)
    center: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        for name in ("size", "periodic", "center"):
            value = getattr(self, name)
            value = tuple(value) if isinstance(value, (list, tuple, np.ndarray)) else (value,) * 3
            if len(value) != 3:
                raise SetupError(f"{name} needs three values")
            if name == "periodic":
                if not all(isinstance(v, bool) for v in value):
                    raise SetupError("periodic flags are booleans")
            else:
                value = tuple(real(v, name) for v in value)
                if name == "size" and min(value) <= 0:
                    raise SetupError("size must be positive")
            object.__setattr__(self, name, value)

    @property
    def lower(self) -> tuple[float, ...]:
        return tuple(c - s / 2 for c, s in zip(self.center, self.size, strict=True))

    @property
    def upper(self) -> tuple[float, ...]:
        return tuple(c + s / 2 for c, s in zip(self.center, self.size, strict=True))

    @property
    def volume(self) -> float:
        return math.prod(self.size)

    def opened(self, axis: int) -> Domain:
        return Domain(self.size, tuple(p and k != axis for k, p in enumerate(self.periodic)), self.center)


def axis_number(axis: int | str) -> int:
    if isinstance(axis, str) and axis.lower() in ("x", "y", "z"):
        return "xyz".index(axis.lower())
    if isinstance(axis, int) and not isinstance(axis, bool) and 0 <= axis <= 2:
        return axis
    raise SetupError(f"axis must be 0, 1, 2, x, y or z, not {axis!r}")
