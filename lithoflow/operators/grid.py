"""Grid metadata, axes and cells.

``iy`` counts from the south and ``ix`` from the west everywhere in DataFrames; only
raster sources and sinks turn the rows around.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_REQUIRED = ("ncols", "nrows", "dx", "dy", "xllcorner", "yllcorner")
_ALIASES = {"cellsize": "dx", "nodata_value": "nodata"}


@dataclass(frozen=True)
class GridMeta:
    ncols: int
    nrows: int
    dx: float
    dy: float
    xllcorner: float
    yllcorner: float
    nodata: float | None = None
    crs: Any = None
    transform: tuple[float, ...] | None = None

    @classmethod
    def of(cls, meta: Mapping[str, Any] | GridMeta) -> GridMeta:
        """From a mapping, with ``cellsize`` and ``nodata_value`` as older names; ``dy`` defaults to ``dx``."""
        if isinstance(meta, GridMeta):
            return meta
        m = {str(k).lower(): v for k, v in meta.items()}
        for old, new in _ALIASES.items():
            if old in m:
                m.setdefault(new, m[old])
        m.setdefault("dy", m.get("dx"))
        missing = [k for k in _REQUIRED if m.get(k) is None]
        if missing:
            raise ValueError(f"grid metadata is missing {missing}")
        out = cls(int(m["ncols"]), int(m["nrows"]), *(float(m[k]) for k in _REQUIRED[2:]), m.get("nodata"), m.get("crs"), tuple(m["transform"][:6]) if m.get("transform") is not None else None)
        return out if out.transform else replace(out, transform=out.affine())

    def affine(self) -> tuple[float, ...]:
        """North-up pixel-to-map transform ``a, b, c, d, e, f``."""
        return (self.dx, 0.0, self.xllcorner, 0.0, -self.dy, self.yllcorner + self.nrows * self.dy)

    def as_dict(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in (*_REQUIRED, "nodata", "crs", "transform")}

    def x(self) -> list[float]:
        return [self.xllcorner + self.dx * (k + 0.5) for k in range(self.ncols)]

    def y(self) -> list[float]:
        return [self.yllcorner + self.dy * (k + 0.5) for k in range(self.nrows)]

    def cells(self, spark: SparkSession) -> DataFrame:
        """``iy, ix, x, y`` of all cell centres, made by ranges on the executors."""
        n = self.ncols
        r = spark.range(self.ncols * self.nrows)
        iy, ix = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
        return r.select(iy.alias("iy"), ix.alias("ix"), (F.lit(self.xllcorner) + F.lit(self.dx) * (ix + 0.5)).alias("x"), (F.lit(self.yllcorner) + F.lit(self.dy) * (iy + 0.5)).alias("y"))


def grids_aligned(a: Mapping | GridMeta, b: Mapping | GridMeta) -> bool:
    """Same shape, spacing and origin, within 1e-6 + 1e-9 of the size; crs and nodata do not matter."""
    a, b = GridMeta.of(a), GridMeta.of(b)
    near = lambda x, y: abs(x - y) <= 1e-6 + 1e-9 * abs(y)
    return (a.ncols, a.nrows) == (b.ncols, b.nrows) and all(near(getattr(a, k), getattr(b, k)) for k in _REQUIRED[2:])


def require_ascending(name: str, axis: Sequence[float]) -> list[float]:
    """The axis as floats; an error unless strictly ascending and finite."""
    out = [float(v) for v in axis]
    if not out or any(not math.isfinite(v) for v in out) or any(b <= a for a, b in zip(out, out[1:])):
        raise ValueError(f"{name} must be a one-dimensional, strictly ascending axis")
    return out


def axes_of(cells: DataFrame) -> tuple[list[float], list[float]]:
    """The two axes of a cell table (``iy, ix, x, y``); they are one-dimensional and small."""
    gx = [r[1] for r in sorted(cells.groupBy("ix").agg(F.min("x")).collect())]
    gy = [r[1] for r in sorted(cells.groupBy("iy").agg(F.min("y")).collect())]
    return require_ascending("grid_x", gx), require_ascending("grid_y", gy)


def cells_of(spark: SparkSession, gx: Sequence[float], gy: Sequence[float]) -> DataFrame:
    """Cells of any two ascending axes."""
    x = spark.createDataFrame([(k, float(v)) for k, v in enumerate(require_ascending("grid_x", gx))], "ix int, x double")
    y = spark.createDataFrame([(k, float(v)) for k, v in enumerate(require_ascending("grid_y", gy))], "iy int, y double")
    return y.crossJoin(F.broadcast(x)).select("iy", "ix", "x", "y")  # the grid itself is this product


def sample_at(points: DataFrame, surface: DataFrame, meta: GridMeta, value: str = "value") -> DataFrame:
    """``points`` (``x, y, ...``) with the value of the nearest cell, clipped to the grid."""
    def index(c, lo, d, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(c) - F.lit(lo + d / 2)) / F.lit(d) + 0.5).cast("int")))

    at = points.withColumn("_iy", index("y", meta.yllcorner, meta.dy, meta.nrows)).withColumn("_ix", index("x", meta.xllcorner, meta.dx, meta.ncols))
    s = surface.select(F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), value)
    return at.join(s, ["_iy", "_ix"], "left").drop("_iy", "_ix")


def depth_and_thickness(bottoms: DataFrame, terrain: DataFrame) -> DataFrame:
    """``iy, ix, layer, bottom, depth, thick``: depth below ``terrain.value`` and distance to the boundary above."""
    t = terrain.select("iy", "ix", F.col("value").alias("_t"))
    above = F.coalesce(F.lag("bottom").over(W.partitionBy("iy", "ix").orderBy("layer")), F.when(F.row_number().over(W.partitionBy("iy", "ix").orderBy("layer")) == 1, F.col("_t")))
    return bottoms.join(t, ["iy", "ix"]).select("iy", "ix", "layer", "bottom", (F.col("_t") - F.col("bottom")).alias("depth"), (above - F.col("bottom")).alias("thick"))


def import_classes(cells: DataFrame, classes: DataFrame, shift: float = 50.0) -> DataFrame:
    """``iy, ix, cls``: class of each cell by coordinate, after shifting the class table by ``shift``.

    Cells outside the table, missing classes and classes below -1 are 0.
    """
    c = classes.select((F.col("x") + shift).alias("x"), (F.col("y") + shift).alias("y"), F.col("cls").alias("_c"))
    k = F.coalesce(F.col("_c"), F.lit(0))
    return cells.join(c, ["x", "y"], "left").select("iy", "ix", F.when(k < -1, 0).otherwise(k).alias("cls"))


def normalize_coordinates(points: DataFrame, xmin: float, ymin: float, dx: float, dy: float) -> DataFrame:
    """``points`` with ``xn, yn``: 1-based grid coordinates, ``(x - min) / step + 1``."""
    return points.withColumn("xn", (F.col("x") - F.lit(float(xmin))) / F.lit(float(dx)) + 1.0).withColumn("yn", (F.col("y") - F.lit(float(ymin))) / F.lit(float(dy)) + 1.0)


def mosaic(tiles: DataFrame, offsets: DataFrame) -> DataFrame:
    """``iy, ix, layer, value`` of cells ``tile, iy, ix, layer, value`` moved by ``tile, oy, ox``; tiles without an offset are left out, of overlaps the largest tile name stays."""
    at = tiles.join(F.broadcast(offsets), "tile").withColumn("iy", F.col("iy") + F.col("oy")).withColumn("ix", F.col("ix") + F.col("ox"))
    return at.groupBy("iy", "ix", "layer").agg(F.max_by("value", "tile").alias("value"))


def match_coordinates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose ``x`` and ``y`` both occur among those of ``b``."""
    return a.join(b.select("x", "y").distinct(), ["x", "y"], "left_semi")
