"""What a model is: ``fit`` on a window gives a fitted state that predicts, and may take newer data at fixed parameters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np

from ..functions.dist import Distribution


@runtime_checkable
class FittedModel(Protocol):
    def predict(self, horizon: int) -> Distribution: ...


@runtime_checkable
class SupportsUpdate(Protocol):
    def update(self, window: np.ndarray) -> FittedModel: ...


@runtime_checkable
class ForecastModel(Protocol):
    name: str
    on_variance: bool  # fits realised variances instead of returns

    def spec(self) -> dict: ...

    def fit(self, window: np.ndarray) -> FittedModel: ...


@dataclass(frozen=True)
class FitStatus:
    """'ok', 'nonconverged' or 'fallback=<n>', with a detail after '|'; '' is for models that report nothing."""

    state: str = ""
    detail: str = ""

    def __str__(self) -> str:
        return f"{self.state}|{self.detail}" if self.detail else self.state


def status_of(fitted) -> str:
    return str(getattr(fitted, "status", ""))


def checked_variance(x: np.ndarray, least: int, allow_zero: bool = False) -> np.ndarray:
    """A float copy of realised variances; at least ``least`` of them, finite and above 0 (or not below, if allowed)."""
    v = np.array(x, np.float64)
    if len(v) < least:
        raise ValueError(f"needs {least} observations, has {len(v)}")
    if not np.isfinite(v).all() or (v < 0).any() or (not allow_zero and (v == 0).any()):
        raise ValueError("realized variance must be finite and positive")
    return v
