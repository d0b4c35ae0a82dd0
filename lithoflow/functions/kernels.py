"""Certainty kernels as column expressions, looked up by name.

A kernel takes ``(dist, range_, width, sill)`` and gives a certainty; a certainty of
0 means total ignorance, whose variance is infinite.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lithoflow.functions.missing import INF, any_null, no_nan

Kernel = Callable[[Column, Column, Column, Column], Column]
_ARGUMENTS = ("dist", "range_", "width", "sill")


def _gauss(d: Column, r: Column, k: float = 3.0) -> Column:
    return F.exp(F.lit(-k) * d * d / (r * r))


def frafa(dist: Column, range_: Column, width: Column, sill: Column) -> Column:
    """The sill on the plateau, a Gaussian fall from its edge outside; the range does not matter on the plateau."""
    return no_nan(F.when(dist <= width, sill).otherwise(sill * _gauss(dist - width, range_)))


def _cut(inner: Column, dist: Column, range_: Column, width: Column, sill: Column) -> Column:
    """``inner`` on the plateau and 0 outside, where an infinite sill times 0 is missing."""
    return no_nan(F.when(any_null(dist, range_, width, sill), F.lit(None)).when(dist <= width, inner).when(sill == INF, F.lit(None)).otherwise(F.lit(0.0)))


def ilm_sep(dist: Column, range_: Column, width: Column, sill: Column) -> Column:
    return _cut(sill * _gauss(dist - width, range_), dist, range_, width, sill)


def ilm_oct(dist: Column, range_: Column, width: Column, sill: Column) -> Column:
    return _cut(sill * _gauss(dist, range_), dist, range_, width, sill)


def rbm(dist: Column, range_: Column, width: Column, sill: Column) -> Column:
    """Two Gaussians that meet at the plateau edge."""
    outer = F.lit(2.0) * sill - sill * _gauss(width, range_, 1.5)
    inside, outside = sill * _gauss(dist, range_, 1.5), outer * _gauss(dist, range_)
    return no_nan(F.when(any_null(dist, range_, width, sill), F.lit(None)).when(dist <= width, inside).otherwise(outside))


_KERNELS: dict[str, Kernel] = {"FRAFA_apr2023": frafa, "ILM_sep2023": ilm_sep, "ILM_oct2023": ilm_oct, "RBM_oct2023": rbm}
_BUILT_IN = frozenset(_KERNELS)


def certainty_function(name: str) -> Kernel:
    if name not in _KERNELS:
        raise ValueError(f"unknown certainty function {name!r}; available: {available_certainty_functions()}")
    return _KERNELS[name]


def available_certainty_functions() -> list[str]:
    return sorted(_KERNELS)


def register_certainty_function(name: str, fn: Kernel, overwrite: bool = False) -> None:
    """Add a kernel; its parameters must be named ``dist, range_, width, sill``."""
    if not name or not isinstance(name, str):
        raise ValueError("a kernel needs a name")
    if not callable(fn) or tuple(inspect.signature(fn).parameters) != _ARGUMENTS:
        raise TypeError(f"a kernel takes exactly {_ARGUMENTS}")
    if name in _KERNELS and not overwrite:
        raise ValueError(f"{name!r} is registered already; pass overwrite=True to replace it")
    _KERNELS[name] = fn


def from_numpy(fn) -> Kernel:
    """Adapter for a vectorised NumPy kernel, run as an Arrow-batched UDF."""
    @F.pandas_udf("double")
    def run(d: pd.Series, r: pd.Series, w: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(fn(d.to_numpy(), r.to_numpy(), w.to_numpy(), s.to_numpy()))

    def kernel(dist, range_, width, sill):
        return no_nan(run(*(c.cast("double") for c in (dist, range_, width, sill))))

    return kernel


def well_kernel(dist: Column, range_: Column, sill: Column) -> Column:
    """Gaussian without plateau."""
    return sill * _gauss(dist, range_)
