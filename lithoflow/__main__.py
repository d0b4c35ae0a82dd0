"""``python -m lithoflow combine``: combine variance stacks of one grid into a floored map."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lithoflow.operators import combine as C
from lithoflow.operators.grid import grids_aligned
from lithoflow.sources import rasters as R


def combine(a: argparse.Namespace, spark: SparkSession) -> None:
    try:
        stacks = [R.read_variance_stack(spark, d, a.prefix) for d in a.theme]
        meta = stacks[0][1]
        prior = None
        if a.prior:
            prior, m = R.read_variance_stack(spark, a.prior, a.prefix)
            stacks.append((prior, m))
        for (_, m), d in zip(stacks, [*a.theme, a.prior]):
            if not grids_aligned(meta, m):
                raise ValueError(f"{d} is not aligned with {a.theme[0]}")
        counts = [s.select(F.max("layer")).first()[0] + 1 for s, _ in stacks]
        if len(set(counts)) > 1:
            raise ValueError(f"stacks differ in layers: {counts}")
        if len(a.bottom) != counts[0]:
            raise ValueError(f"{len(a.bottom)} bottoms for {counts[0]} layers")
        terrain, tm = R.load_grid(spark, a.terrain)
        bottoms = None
        for k, path in enumerate(a.bottom):
            b, bm = R.load_grid(spark, path)
            for what, m in ((a.terrain, tm), (path, bm)):
                if not grids_aligned(meta, m):
                    raise ValueError(f"{what} is not aligned with {a.theme[0]}")
            b = b.select("iy", "ix", F.lit(k).alias("layer"), F.col("value").alias("bottom"))
            bottoms = b if bottoms is None else bottoms.unionByName(b)
    except (ValueError, FileNotFoundError) as e:
        raise SystemExit(str(e)) from e
    all_stacks = [s for s, _ in stacks]
    themes = all_stacks[: len(a.theme)]
    low = C.minimum_map(bottoms, terrain.withColumnRenamed("value", "terrain"))
    out = C.apply_floor(C.combine_variances(themes, prior=prior), low)
    R.write_variance_stack(out, meta, a.out, a.out_prefix)
    R.write_display_stack(out, meta, a.out, C.informed_mask(all_stacks), a.std_prefix)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lithoflow")
    c = p.add_subparsers(dest="command", required=True).add_parser("combine")
    c.add_argument("--theme", action="append", required=True, metavar="DIR")
    g = c.add_mutually_exclusive_group(required=True)
    g.add_argument("--prior", metavar="DIR")
    g.add_argument("--no-prior", action="store_true")
    c.add_argument("--terrain", required=True)
    c.add_argument("--bottom", action="append", required=True)
    c.add_argument("--out", required=True)
    for flag, default in (("--prefix", "variance"), ("--out-prefix", "variance"), ("--std-prefix", "std")):
        c.add_argument(flag, default=default)
    return p


def main(argv: list[str] | None = None) -> int:
    combine(parser().parse_args(argv), SparkSession.builder.appName("lithoflow").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main())
