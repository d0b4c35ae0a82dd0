"""Rasters and DataFrames: grids, stacks of layers, and their sinks.

Files are read by Spark itself (any store it reads) and decoded on the executors,
one task per file; written files are encoded on the executors and put in place
through Spark's file system, one layer at a time.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.functions.missing import SENTINEL
from lithoflow.operators.grid import GridMeta, grids_aligned
from lithoflow.sources import codecs

_META = "path string, ncols int, nrows int, dx double, dy double, xllcorner double, yllcorner double, nodata double, crs string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def grid_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file."""
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                m = codecs.decoder_for(p)(bytes(c))[1]
                out.append((p, m.ncols, m.nrows, m.dx, m.dy, m.xllcorner, m.yllcorner, m.nodata, None if m.crs is None else str(m.crs)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _META.split(", ")])

    return _files(spark, path).mapInPandas(run, _META)


def meta_of(row) -> GridMeta:
    d = row.asDict()
    d.pop("path")
    if d["nodata"] is not None and np.isnan(d["nodata"]):
        d["nodata"] = None
    return GridMeta.of(d)


def read_cells(spark: SparkSession, path: str, nodata_missing: bool = True) -> DataFrame:
    """``path, iy, ix, value`` of one file or a pattern, rows counted from the south.

    With ``nodata_missing`` stored nodata becomes NULL, otherwise it stays as it is.
    """
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                z, m = codecs.decoder_for(p)(bytes(c))
                if nodata_missing and m.nodata is not None:
                    z = np.where(z == m.nodata, np.nan, z)
                for r in range(0, m.nrows, max(1, 200_000 // max(1, m.ncols))):
                    part = z[r : r + max(1, 200_000 // max(1, m.ncols))]
                    y, x = np.indices(part.shape)
                    yield pd.DataFrame({"path": p, "iy": (m.nrows - 1 - (y.ravel() + r)).astype(np.int32), "ix": x.ravel().astype(np.int32), "value": part.ravel()})

    df = _files(spark, path).mapInPandas(run, "path string, iy int, ix int, value double")
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def load_grid(spark: SparkSession, path: str) -> tuple[DataFrame, GridMeta]:
    """``iy, ix, value`` and the metadata of one grid file, by extension."""
    codecs.decoder_for(path)
    rows = grid_metadata(spark, path).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} names {len(rows)} files")
    return read_cells(spark, path, nodata_missing=not path.lower().endswith((".tif", ".tiff"))).drop("path"), meta_of(rows[0])


def read_variance_stack(spark: SparkSession, folder: str, prefix: str = "variance") -> tuple[DataFrame, GridMeta]:
    """``iy, ix, layer, variance`` of ``<prefix>_*.tif`` in the order of names, and the metadata of the first."""
    pattern = f"{folder.rstrip('/')}/{prefix}_*.tif"
    try:
        metas = sorted(grid_metadata(spark, pattern).collect(), key=lambda r: r["path"])
    except Exception as e:
        if re.search(r"PATH_NOT_FOUND|does not exist", str(e)):
            metas = []
        else:
            raise
    if not metas:
        raise FileNotFoundError(f"no files {pattern}")
    if len({(r["nrows"], r["ncols"]) for r in metas}) > 1:
        raise ValueError(f"layers of {pattern} differ in shape")
    order = spark.createDataFrame([(r["path"], k) for k, r in enumerate(metas)], "path string, layer int")
    cells = read_cells(spark, pattern).join(F.broadcast(order), "path")
    return cells.select("iy", "ix", "layer", F.col("value").alias("variance")), meta_of(metas[0])


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write ``content`` to any store that Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    with tempfile.NamedTemporaryFile() as f:  # a staging copy on the driver alone
        f.write(content)
        f.flush()
        fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), p)


def write_layers(cells: DataFrame, meta: GridMeta, folder: str, prefix: str, nodata: float | None, value: str, fmt: str = "tif") -> list[str]:
    """``<prefix>_NN.<fmt>``, numbered from 1, of ``iy, ix, layer, value``; returns the names."""
    spark, meta = cells.sparkSession, GridMeta.of(meta)
    bad = cells.where(~F.col("iy").between(0, meta.nrows - 1) | ~F.col("ix").between(0, meta.ncols - 1)).limit(1).collect()
    if bad:
        raise ValueError(f"cell ({bad[0]['iy']}, {bad[0]['ix']}) lies outside the grid")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((meta.nrows, meta.ncols), np.nan)
        z[meta.nrows - 1 - pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf["v"].to_numpy(float)
        raw = codecs.write_geotiff(z, meta, nodata) if fmt == "tif" else codecs.write_esri(z, meta, -9999.0 if nodata is None else nodata)
        return pd.DataFrame({"layer": [int(pdf["layer"].iloc[0])], "content": [raw]})

    rows = cells.select(F.col("layer").cast("int").alias("layer"), "iy", "ix", F.col(value).cast("double").alias("v")).groupBy("layer").applyInPandas(encode, "layer int, content binary")
    names = []
    for r in rows.toLocalIterator():
        names.append(f"{folder.rstrip('/')}/{prefix}_{r['layer'] + 1:02d}.{fmt}")
        put_file(spark, names[-1], bytes(r["content"]))
    return sorted(names)


def write_variance_stack(stack: DataFrame, meta: GridMeta, folder: str, prefix: str = "variance", nodata: float | None = None) -> list[str]:
    """Variances as computed, the sentinel included; missing ones become nodata (that of ``meta`` by default)."""
    meta = GridMeta.of(meta)
    return write_layers(stack, meta, folder, prefix, meta.nodata if nodata is None else nodata, "variance")


def write_display_stack(stack: DataFrame, meta: GridMeta, folder: str, informed: DataFrame | None = None, prefix: str = "std", nodata: float = -9999.0) -> list[str]:
    """Standard deviations; nodata where not finite, negative, or not informed."""
    v = F.col("variance")
    s = F.when((v >= 0) & (v != float("inf")), F.sqrt(v))
    rows = stack
    if informed is not None:
        rows = rows.join(informed, ["iy", "ix", "layer"], "left")
        s = F.when(F.coalesce("informed", F.lit(False)), s)
    return write_layers(rows.withColumn("_std", s), meta, folder, prefix, nodata, "_std")


def ascii_to_geotiff(spark: SparkSession, source: str, target: str | None = None, crs=None, crop: tuple[float, float, float, float] | None = None) -> str:
    """One ESRI ASCII file (six header lines, corner reference) as GeoTIFF, cropped to ``xmin, xmax, ymin, ymax``."""
    content = bytes(_files(spark, source).first()["content"])
    head = [line.split()[0].lower() for line in content.decode("utf-8", "replace").splitlines()[:6] if line.split()]
    if sorted(head) != sorted(["ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value"]):
        raise ValueError(f"{source}: six header lines with a corner reference are expected, found {head}")
    z, m = codecs.read_esri(content)
    y0 = m.yllcorner
    if crop is not None:
        xmin, xmax, ymin, ymax = crop
        top = m.yllcorner + m.nrows * m.dy
        a, b = max(0, int((xmin - m.xllcorner) / m.dx)), min(m.ncols, int((xmax - m.xllcorner) / m.dx))
        r0, r1 = max(0, int((top - ymax) / m.dy)), min(m.nrows, int((top - ymin) / m.dy))
        if a >= b or r0 >= r1:
            raise ValueError("the crop does not meet the grid")
        z, y0 = z[r0:r1, a:b], top - r1 * m.dy
        m = GridMeta.of(m.as_dict() | {"ncols": b - a, "nrows": r1 - r0, "xllcorner": m.xllcorner + a * m.dx, "yllcorner": y0, "transform": None})
    m = GridMeta.of(m.as_dict() | {"crs": crs, "transform": None})
    target = target or re.sub(r"\.[^./]*$", "", source) + ".tif"
    put_file(spark, target, codecs.write_geotiff(z, m, -9999.0 if m.nodata is None else m.nodata))
    return target


def export_realizations(model: DataFrame, meta: GridMeta, folder: str, names: list[str], first: int = 0) -> list[str]:
    """``realizations/realization<k>/<layer>.asc`` of ``iy, ix, boundary, real, elevation``."""
    n = model.select(F.max("boundary")).first()[0] + 1
    if n != len(names):
        raise ValueError(f"{len(names)} names for {n} boundaries")
    spark, meta = model.sparkSession, GridMeta.of(meta)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((meta.nrows, meta.ncols), np.nan)
        z[meta.nrows - 1 - pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf["elevation"].to_numpy(float)
        return pd.DataFrame({"real": [int(pdf["real"].iloc[0])], "boundary": [int(pdf["boundary"].iloc[0])], "content": [codecs.write_esri(z, meta)]})

    rows = model.select("iy", "ix", "real", "boundary", "elevation").groupBy("real", "boundary").applyInPandas(encode, "real int, boundary int, content binary")
    out = []
    for r in rows.toLocalIterator():
        out.append(f"{folder.rstrip('/')}/realizations/realization{r['real'] + first}/{names[r['boundary']]}.asc")
        put_file(spark, out[-1], bytes(r["content"]))
    return sorted(out)


def perturb_layer_boundaries(spark: SparkSession, folder: str, k: float = 1, method: str = "shift", output: str = "perturbed", layers: list[str] | None = None) -> list[str]:
    """Perturbed copies of the surfaces ``<folder>/*.tif``; returns the files written.

    ``shift`` lowers all surfaces but ``top_surface`` by ``k``; ``realization`` takes
    those of ``<folder>/realization<k>``. The output folder is emptied first.
    """
    if method not in ("shift", "realization"):
        raise ValueError(f"unknown method {method!r}; shift and realization are known")
    source = folder.rstrip("/") if method == "shift" else f"{folder.rstrip('/')}/realization{int(k)}"
    metas = {r["path"]: meta_of(r) for r in grid_metadata(spark, f"{source}/*.tif").collect()}
    name = {p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in metas}
    chosen = {p: n for p, n in name.items() if layers is None or n in layers}
    if not chosen:
        raise ValueError(f"no surfaces in {source}")
    p = spark._jvm.org.apache.hadoop.fs.Path(output)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    shift = float(k) if method == "shift" else 0.0

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if path in chosen:
                    z, m = codecs.read_geotiff(bytes(content))
                    keep = np.isnan(z) if m.nodata is None else np.isnan(z) | (z == m.nodata)
                    out.append((chosen[path], codecs.write_geotiff(np.where(keep | (chosen[path] == "top_surface"), z, z - shift), m, m.nodata)))
            yield pd.DataFrame(out, columns=["name", "content"])

    files = []
    for r in _files(spark, f"{source}/*.tif").mapInPandas(run, "name string, content binary").toLocalIterator():
        files.append(f"{output.rstrip('/')}/{r['name']}.tif")
        put_file(spark, files[-1], bytes(r["content"]))
    return sorted(files)


def check_aligned(metas: dict[str, GridMeta]) -> None:
    items = list(metas.items())
    for name, m in items[1:]:
        if not grids_aligned(items[0][1], m):
            raise ValueError(f"{name} is not aligned with {items[0][0]}")


def uninformed(v):
    return v.isNull() | (v >= SENTINEL)
