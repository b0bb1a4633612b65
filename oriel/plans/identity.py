"""Identity of an experiment: its configuration as one JSON text, hashed; digests of its data.

JSON has no dates, sets, or floats apart from integers.  Values it lacks are
objects with a single key that names their type, and mappings are such objects
too, so no value can be mistaken for another.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import platform
from functools import singledispatch

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

VERSION = "0.2.0"


@singledispatch
def plain(value):
    """What JSON writes for a value."""
    raise TypeError(f"a configuration cannot hold {type(value).__name__}")


for _kind in (str, bool, type(None)):
    plain.register(_kind, lambda value: value)
for _kind in (int, np.integer):
    plain.register(_kind, int)
for _kind in (list, tuple):
    plain.register(_kind, lambda value: [plain(x) for x in value])
for _kind in (set, frozenset):
    plain.register(_kind, lambda value: {"set": sorted(map(text_of, value))})
plain.register(bool, lambda value: value)
plain.register(np.bool_, bool)
plain.register(np.ndarray, lambda value: plain(value.tolist()))
plain.register(dt.date, lambda value: {"time": value.isoformat()})


@plain.register(float)
@plain.register(np.floating)
def _(value):
    return {"float": (float(value) + 0.0).hex()}  # exact; adding 0 makes -0 and 0 one


@plain.register(dict)
def _(value):
    for k in value:
        if type(k) is not str:
            raise TypeError("names in a configuration are strings")
    return {"map": {k: plain(x) for k, x in value.items()}}


def text_of(value) -> str:
    """One text for equal values of one type, different texts otherwise."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"))


def config_hash(config: dict) -> str:
    if not isinstance(config, dict):
        raise TypeError("a configuration is a dictionary")
    return hashlib.sha256(text_of(config).encode()).hexdigest()


def experiment(model, data: dict, splitter, seed: int, recondition: str = "daily", scoring: dict | None = None, policy: str = "none", environment: dict | None = None) -> dict:
    """The configuration that names a cell.

    The protocol between refits counts only if there are origins between refits,
    the policy for invalid targets only if there is one.
    """
    refits = {"every": splitter.refit_every}
    if splitter.refit_every > 1:
        refits["between"] = recondition
    return {
        "model": [model.name, dict(model.spec())],
        "data": dict(data),
        "origins": {"window": splitter.window, "horizon": splitter.horizon, "step": splitter.step},
        "refits": refits,
        "targets": [policy] if policy != "none" else [],
        "scoring": dict(scoring or {}),
        "seed": int(seed),
        "made_by": [VERSION, dict(machine() if environment is None else environment)],
    }


def machine() -> dict:
    """What a machine contributes to results: its linear algebra threads."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        if os.environ.get(name, "").isdigit():
            return {"blas_threads": int(os.environ[name])}
    return {"blas_threads": 0}


def report() -> dict:
    return machine() | {"python": platform.python_version(), "numpy": np.__version__, "pandas": pd.__version__, "machine": platform.machine()}


def array_digest(x) -> str:
    return hashlib.sha256(np.ascontiguousarray(x, "<f8").tobytes()).hexdigest()


def digests(series: DataFrame, column: str) -> DataFrame:
    """sha256 of each asset's values in order of position; null is NaN."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": [pdf.asset.iloc[0]], "digest": [array_digest(pdf.sort_values("pos").x.to_numpy(float))]})

    return series.selectExpr("asset", "pos", f"cast({column} as double) as x").groupBy("asset").applyInPandas(one, "asset string, digest string")
