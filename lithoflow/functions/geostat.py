"""Variograms, covariances, inversion and draws: dense linear algebra on arrays, and columns where rows suffice."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Variogram = list[dict]
_PART = re.compile(r"\s*([-+]?[\w.]+(?:[eE][-+]?\d+)?)\s+([A-Za-z]\w*)\s*\(\s*([^()]*)\)\s*(\+|$)")
#: Fixed value: added to the diagonal before a factorisation.
NUGGET = 1e-5


def parse_variogram(text: str) -> Variogram:
    """``"<sill> <Model>(<range>) + ..."`` as dicts ``type, par1`` (sill) and ``par2`` (range)."""
    out, pos, more = [], 0, True
    while more:
        m = _PART.match(text, pos)
        if not m:
            raise ValueError(f"cannot read variogram {text!r} from {text[pos:]!r} on")
        try:
            sill, rng = float(m[1]), float(m[3].split(",")[0])
        except ValueError as e:
            raise ValueError(f"cannot read variogram part {m[0]!r}") from e
        if not (math.isfinite(sill) and math.isfinite(rng)):
            raise ValueError(f"variogram part {m[0]!r} is not finite")
        out.append({"type": m[2], "par1": sill, "par2": rng})
        pos, more = m.end(), bool(m[4])
    return out


def _model(name: str) -> str:
    k = name[:3].lower()
    if k not in ("sph", "exp", "gau"):
        raise ValueError(f"unknown variogram model {name!r}; sph, exp and gau are known")
    return k


def semivariance(v: Variogram, d: np.ndarray) -> np.ndarray:
    d = np.asarray(d, float)
    out = np.zeros_like(d)
    for p in v:
        h = d / p["par2"]
        match _model(p["type"]):
            case "sph":
                g = np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0)
            case "exp":
                g = -np.expm1(-3 * h)
            case _:
                g = -np.expm1(-3 * h * h)
        out += p["par1"] * g
    return out


def semivariance_column(v: Variogram, d: Column) -> Column:
    total = F.lit(0.0)
    for p in v:
        h = d / F.lit(p["par2"])
        match _model(p["type"]):
            case "sph":
                g = F.when(h < 1, F.lit(1.5) * h - F.lit(0.5) * h * h * h).otherwise(F.lit(1.0))
            case "exp":
                g = F.lit(1.0) - F.exp(F.lit(-3.0) * h)
            case _:
                g = F.lit(1.0) - F.exp(F.lit(-3.0) * h * h)
        total = total + F.lit(p["par1"]) * g
    return total


def covariance_column(v: Variogram, d: Column) -> Column:
    return F.lit(float(sum(p["par1"] for p in v))) - semivariance_column(v, d)


def distances(a: np.ndarray, b: np.ndarray | None = None, transform=None) -> np.ndarray:
    """Euclidean distances between rows of ``a`` and ``b`` (the origin without ``b``); one-dimensional input is a line."""
    if transform is not None:
        raise NotImplementedError("anisotropic distances are not supported")
    a = np.asarray(a, float)
    a = a[:, None] if a.ndim == 1 else a
    b = np.zeros((1, a.shape[1])) if b is None else np.asarray(b, float)
    b = b[:, None] if b.ndim == 1 else b
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def covariance(a: np.ndarray, b: np.ndarray, v: Variogram | str) -> np.ndarray:
    v = parse_variogram(v) if isinstance(v, str) else v
    return sum(p["par1"] for p in v) - semivariance(v, distances(a, b))


def kriging_system(x: np.ndarray, y: np.ndarray, obs: np.ndarray, std: np.ndarray, is_data: np.ndarray, sill: float, range_: float, noise_correlation: float):
    """Prior covariance of the cells, data covariance and data of the conditioned ones (``is_data``)."""
    xy = np.column_stack([x, y])
    cm = covariance(xy, xy, [{"type": "Gau", "par1": sill, "par2": range_}])
    at = xy[is_data]
    shape = covariance(at, at, [{"type": "Gau", "par1": 1.0, "par2": range_}])
    s = std[is_data]
    cd = np.outer(s, s) * (noise_correlation * shape + (1 - noise_correlation) * np.eye(len(s)))
    return cm, cd, obs[is_data]


def invert(cm: np.ndarray, cd: np.ndarray, d: np.ndarray, rows: np.ndarray, m0: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares mean and covariance of the cells given data ``d`` at ``rows``."""
    m0 = np.broadcast_to(np.asarray(m0, float), (len(cm),))
    if not len(rows):
        return m0.copy(), cm
    cross = cm[:, rows]
    gain = np.linalg.solve(cd + cm[np.ix_(rows, rows)], cross.T).T
    return m0 + gain @ (d - m0[rows]), cm - gain @ cross.T


def least_squares_inversion(g: np.ndarray, cm: np.ndarray, cd: np.ndarray, m0, d0: np.ndarray, type: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """General forward matrix ``g``; type 1 only updates the cells that ``g`` sees."""
    g, m0 = np.asarray(g, float), np.broadcast_to(np.asarray(m0, float), (len(cm),)).copy()
    if type not in (1, 2):
        raise ValueError("type must be 1 or 2")
    on = np.flatnonzero(np.any(g != 0, axis=0)) if type == 1 else np.arange(len(cm))
    c, gg = cm[:, on], g[:, on]
    gain = np.linalg.solve(cd + gg @ cm[np.ix_(on, on)] @ gg.T, gg @ c.T).T
    return m0 + gain @ (d0 - g @ m0), cm - gain @ gg @ c.T


def cholesky_draws(cov: np.ndarray, n: int, rng: np.random.Generator, m0=None) -> np.ndarray:
    """``(cells, n)`` draws with covariance ``cov`` and mean ``m0``."""
    if m0 is not None and np.ndim(m0) and len(m0) != len(cov):
        raise ValueError(f"m0 has {len(m0)} values for {len(cov)} cells")
    out = np.linalg.cholesky(cov + NUGGET * np.eye(len(cov))) @ rng.standard_normal((len(cov), n))
    return out if m0 is None else out + np.reshape(np.broadcast_to(m0, (len(cov),)), (-1, 1))


def synthetic_field(nx: int, ny: int, dx: float, range_: float, sill: float, dy: float | None = None, model: str = "Gau", seed: int = 0) -> np.ndarray:
    """A random surface ``(ny, nx)`` with the given variogram."""
    dy = dx if dy is None else dy
    gx, gy = np.meshgrid((np.arange(nx) + 0.5) * dx, (np.arange(ny) + 0.5) * dy)
    xy = np.column_stack([gx.ravel(), gy.ravel()])
    return cholesky_draws(covariance(xy, xy, [{"type": model, "par1": sill, "par2": range_}]), 1, np.random.default_rng(seed)).reshape(ny, nx)


def interpolate(xs: Sequence[float], ys: Sequence[float], values: Sequence[float], half_extent: float, size: int, method: str = "linear") -> np.ndarray:
    """Values at scattered points on a ``size`` x ``size`` grid over ``[-half_extent, half_extent]``; missing (NaN) with fewer than 4 points.

    ``nearest`` and ``linear`` (Delaunay triangles, NaN outside the hull) are own
    code; ``cubic`` needs SciPy.
    """
    xs, ys, values = (np.asarray(v, float) for v in (xs, ys, values))
    gx, gy = np.meshgrid(*[np.linspace(-half_extent, half_extent, size)] * 2)
    if len(xs) < 4:
        return np.full((size, size), np.nan)
    if method == "nearest":
        d = (gx.ravel()[:, None] - xs) ** 2 + (gy.ravel()[:, None] - ys) ** 2
        return values[d.argmin(axis=1)].reshape(size, size)
    if method == "linear":
        return _linear(xs, ys, values, gx, gy)
    if method == "cubic":
        try:
            from scipy.interpolate import griddata
        except ImportError as e:
            raise ImportError("cubic interpolation needs SciPy; use method='linear' or 'nearest'") from e
        return griddata(np.column_stack([xs, ys]), values, (gx, gy), method="cubic")
    raise ValueError(f"unknown method {method!r}")


def delaunay(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Triangles ``(n, 3)`` by insertion: those whose circle holds a new point are replaced by a fan to it."""
    n = len(xs)
    cx, cy = xs.mean(), ys.mean()
    r = 1e4 * (max(np.ptp(xs), np.ptp(ys)) + 1e-9)
    px = np.concatenate([xs, [cx - 2 * r, cx + 2 * r, cx]])
    py = np.concatenate([ys, [cy - r, cy - r, cy + 2 * r]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        ax, ay, bx, by, ex, ey = px[t[:, 0]], py[t[:, 0]], px[t[:, 1]], py[t[:, 1]], px[t[:, 2]], py[t[:, 2]]
        bx, by, ex, ey = bx - ax, by - ay, ex - ax, ey - ay
        det = 2 * (bx * ey - by * ex)
        det = np.where(det == 0, 1e-300, det)
        b2, e2 = bx * bx + by * by, ex * ex + ey * ey
        ux, uy = (ey * b2 - by * e2) / det, (bx * e2 - ex * b2) / det
        return np.column_stack([ax + ux, ay + uy, ux * ux + uy * uy])

    circ = circles(tri)
    for k in range(n):
        hit = (circ[:, 0] - px[k]) ** 2 + (circ[:, 1] - py[k]) ** 2 < circ[:, 2] * (1 - 1e-12)
        if not hit.any():
            continue
        edges = np.sort(np.concatenate([tri[hit][:, [0, 1]], tri[hit][:, [1, 2]], tri[hit][:, [2, 0]]]), axis=1)
        edge, times = np.unique(edges, axis=0, return_counts=True)
        fan = np.column_stack([edge[times == 1], np.full((times == 1).sum(), k)])
        tri = np.vstack([tri[~hit], fan])
        circ = np.vstack([circ[~hit], circles(fan)])
    return tri[(tri < n).all(axis=1)]


def _linear(xs, ys, values, gx, gy):
    out = np.full(gx.shape, np.nan)
    for a, b, c in delaunay(xs, ys):
        det = (ys[b] - ys[c]) * (xs[a] - xs[c]) + (xs[c] - xs[b]) * (ys[a] - ys[c])
        if abs(det) < 1e-12:
            continue
        l1 = ((ys[b] - ys[c]) * (gx - xs[c]) + (xs[c] - xs[b]) * (gy - ys[c])) / det
        l2 = ((ys[c] - ys[a]) * (gx - xs[c]) + (xs[a] - xs[c]) * (gy - ys[c])) / det
        l3 = 1 - l1 - l2
        inside = (l1 >= -1e-9) & (l2 >= -1e-9) & (l3 >= -1e-9)
        out[inside] = (l1 * values[a] + l2 * values[b] + l3 * values[c])[inside]
    return out
