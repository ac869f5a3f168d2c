"""Results as JSON: any result of this package, in plain types; numbers that aren't finite are errors."""

from __future__ import annotations

import dataclasses
import datetime
import enum
import json
import math
import os
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Row

from porespan.policy import SetupError

#: Rows of a table that a document holds at most; write larger ones with Spark.
MAX_ROWS = 100_000


def plain(value, where: str = "result"):
    """``value`` in dicts, lists, strings, numbers, booleans and None. Tables are lists of rows, sorted by nothing."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, enum.Enum):
        return plain(value.value, where)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, np.bool_):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        if not math.isfinite(value):
            raise SetupError(f"{where} is not a finite number")
        return float(value)
    if isinstance(value, DataFrame):
        rows = value.limit(MAX_ROWS + 1).collect()
        if len(rows) > MAX_ROWS:
            raise SetupError(f"{where} has more than {MAX_ROWS} rows; write it with Spark")
        return [plain(r, f"{where}[{i}]") for i, r in enumerate(rows)]
    if isinstance(value, Row):
        return plain(value.asDict(), where)
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name), f"{where}.{f.name}") for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        if len({str(k) for k in value}) < len(value):
            raise SetupError(f"{where} has keys that are equal as text")
        return {str(k): plain(v, f"{where}.{k}") for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return plain(value.tolist(), where)
    if isinstance(value, (list, tuple)):
        return [plain(v, f"{where}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v, where) for v in value)
    if isinstance(value, os.PathLike):
        return os.fspath(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise SetupError(f"{where} can't be written as JSON: {type(value).__name__}")


def dumps(value, indent: int | None = 2) -> str:
    return json.dumps(plain(value), sort_keys=True, indent=indent, allow_nan=False, ensure_ascii=False) + "\n"


def write_json(value, path: str) -> None:
    text = dumps(value)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
