"""Registered queries of the layer-uncertainty operators and their DuckDB counterparts.

Each query starts from the fixtures; the Spark side uses the operators, the SQL side
is a plain independent formulation. Variances beyond 1e6, infinite ones included,
are shown as 1e6, and figures are rounded, as the engines differ in the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.functions import expressions, geostat, kernels
from lithoflow.operators import clean, clusters, combine, grid, kriging, nearest, neighbourhood, points, rangesill, stacking, themes, wells
from lithoflow.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
GX, GY = X.axes()
N_PREREQ = 2


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def shown(v: Column, digits: int = 4) -> Column:
    return F.when(v > 1e6, F.lit(1e6)).otherwise(F.round(v, digits))


def shown_sql(v: str, digits: int = 4) -> str:
    return f"CASE WHEN {v} > 1e6 THEN 1e6::double ELSE round({v}, {digits}) END"


# ---- fixtures as frames and as SQL
def cells(spark, d):
    return X.frame(spark, d, X.CELLS)


def obs(spark, d):
    return X.frame(spark, d, X.POINTS)


def attrs(spark, d):
    return X.frame(spark, d, X.ATTRIBUTES)


def bottoms(spark, d):
    return X.frame(spark, d, X.BOTTOMS).where(f"layer < {X.LAYERS}")


def _near(radius: int, reducers: dict[str, str], layered: bool = True, t: str = "") -> str:
    """Naive window join, ties and reducers; ``t`` begins the names of the steps."""
    lo, hi = f"greatest(0, {{0}} - {radius})", f"least({X.SIDE - 1}, {{0}} + {radius})"
    agg = {"mean": "avg", "min": "min", "max": "max"}
    cols = ", ".join(f"CASE WHEN count(a.{c}) = count(*) THEN {agg[r]}(a.{c}) END AS {c}" for c, r in reducers.items() if r != "first")
    first = "".join(f", any_value(f.{c}) AS {c}" for c, r in reducers.items() if r == "first")
    f_join = f" JOIN (SELECT c.iy, c.ix, a.* FROM (SELECT iy, ix, min(pid) AS pid FROM {t}cand GROUP BY iy, ix) c JOIN {t}attr a ON a.pid = c.pid) f ON f.iy = n.iy AND f.ix = n.ix AND f.layer = a.layer" if first else ""
    key = "n.iy, n.ix, a.layer" if layered else "n.iy, n.ix"
    src = f"{t}attr" if layered else f"{t}pts"
    return f"""{t}cells AS ({X.CELLS}), {t}pts AS ({X.POINTS}), {t}attr AS ({X.ATTRIBUTES}),
{t}cand AS (SELECT c.iy, c.ix, p.pid, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM {t}cells c JOIN {t}pts p
  ON p.x > 500050 + 100 * {lo.format("c.ix")} AND p.x < 500050 + 100 * {hi.format("c.ix")}
  AND p.y > 6100050 + 100 * {lo.format("c.iy")} AND p.y < 6100050 + 100 * {hi.format("c.iy")}),
{t}near AS (SELECT iy, ix, pid, d FROM {t}cand QUALIFY d = min(d) OVER (PARTITION BY iy, ix)),
{t}red AS (SELECT {key}, min(n.d) AS d, count(*) AS n_ties{", " + cols if cols else ""}{first} FROM {t}near n JOIN {src} a ON a.pid = n.pid{f_join} GROUP BY {key})"""


@query(f"WITH {_near(6, {'depth': 'mean', 'thick': 'min', 'doi': 'max'}, False)} SELECT iy, ix, round(d, 6) AS d, n_ties, round(depth, 6) AS depth, thick, doi FROM red")
def windowed_nearest_ties(spark, d):
    p = obs(spark, d)
    out = nearest.windowed_nearest(p, GX, GY, 6, {"depth": "mean", "thick": "min", "doi": "max"})
    return out.select("iy", "ix", F.round("d", 6).alias("d"), "n_ties", F.round("depth", 6).alias("depth"), "thick", "doi")


@query(f"WITH {_near(3, {}, False)} SELECT iy, ix, arg_min(mep_type, pid) AS mep_type, min(pid) AS pid FROM cand JOIN pts USING (pid) GROUP BY iy, ix")
def window_first_attribute(spark, d):
    cand = nearest.candidates(obs(spark, d).select("pid", "x", "y", "mep_type"), GX, GY, 3)
    return cand.groupBy("iy", "ix").agg(F.min_by("mep_type", "pid").alias("mep_type"), F.min("pid").alias("pid"))


# ---- themes: formulae in SQL, written out independently
_KERNEL_SQL = {
    "FRAFA_apr2023": "CASE WHEN d <= w THEN s WHEN r IS NULL THEN NULL ELSE s * exp(-3 * (d - w) * (d - w) / (r * r)) END",
    "ILM_sep2023": "CASE WHEN d IS NULL OR w IS NULL OR r IS NULL OR s IS NULL THEN NULL WHEN d <= w THEN s * exp(-3 * (d - w) * (d - w) / (r * r)) WHEN isinf(s) THEN NULL ELSE 0 END",
    "ILM_oct2023": "CASE WHEN d IS NULL OR w IS NULL OR r IS NULL OR s IS NULL THEN NULL WHEN d <= w THEN s * exp(-3 * d * d / (r * r)) WHEN isinf(s) THEN NULL ELSE 0 END",
    "RBM_oct2023": "CASE WHEN d <= w THEN s * exp(-1.5 * d * d / (r * r)) ELSE (2 * s - s * exp(-1.5 * w * w / (r * r))) * exp(-3 * d * d / (r * r)) END",
}
# name: parameters, var0, plateau, mask, fills
_THEMES = {
    "paces": ({}, "pow(0.5 * greatest(2, 0.25 * depth), 2)", "75", "18 < depth", {}),
    "pacep": ({}, "pow(0.5 * greatest(5, 0.5 * depth), 2)", "75", "doi < depth", {"doi": 15}),
    "mep": ({"doi_fill": 44.0}, "pow(0.5 * greatest(2.4, 0.25 * depth) * mep_type + 0.5 * greatest(1.25, 0.15 * depth) * CASE WHEN mep_type = 0 THEN 1 ELSE 0 END, 2)", "75", "doi < depth", {"doi": 44}),
    "gammalog": ({}, "CASE WHEN depth < 3 THEN 100000 ELSE pow(1.5 + 0 * depth, 2) END", "150", "thick < depth", {}),
    "reslog": ({}, "CASE WHEN depth < 10 THEN 100000 ELSE 0.25 + pow(0.045 * depth, 2) END", "150", "thick < depth", {}),
    "refseis": ({"active_layers": [0, 2]}, "56.25", "1", "thick < 100", {}),
    "skytem": ({}, "CASE WHEN depth < 5 THEN 100000 ELSE pow(0.6 * thick, 2) END", "greatest(2 * depth, 75)", "doi < depth", {}),
    "fewtem": ({}, "CASE WHEN depth < 10 THEN 10000 ELSE pow(greatest(1.2, 0.075 * depth) + 2, 2) END", "greatest(depth, 75)", "doi < depth", {}),
    "manytem": ({}, "CASE WHEN depth < 7 THEN 100000 ELSE pow(0.6 * thick, 2) END", "greatest(depth, 75)", "doi < depth", {}),
    "ttem": ({}, "CASE WHEN depth < 2 THEN 10000 ELSE pow(0.6 * thick, 2) END", "greatest(depth, 75)", "doi < depth", {}),
    "tem": ({"cert_fun_name": "RBM_oct2023"}, "CASE WHEN depth < 10 THEN 10000 ELSE pow(greatest(1.2, 0.075 * depth) + 2, 2) END", "greatest(depth, 75)", "doi < depth", {}),
}


def _theme_ctes(spec: themes.ThemeSpec, var0: str, width: str, mask: str, fills: dict, active=None, t: str = "") -> str:
    red = {a: spec.reducers[a] for a in spec.attributes}
    ranges = " UNION ALL ".join(f"SELECT {lay} AS layer, {c} AS cls, {r}::double AS r" for lay, c, r in themes.range_rows(spec.range_model, X.LAYERS))
    cols = ", ".join(f"coalesce(red.{a}, {fills[a]}) AS {a}" if a in fills else f"red.{a}" for a in red)
    on = f"WHEN layer NOT IN ({', '.join(map(str, active))}) THEN 100000 " if active is not None else ""
    return f"""{_near(spec.search_radius, red, True, t)},
{t}ranges AS ({ranges}),
{t}f AS (SELECT c.iy, c.ix, l.layer, red.d, g.r, {cols} FROM {t}cells c CROSS JOIN (SELECT unnest(range({X.LAYERS})) AS layer) l
  LEFT JOIN {t}red red ON red.iy = c.iy AND red.ix = c.ix AND red.layer = l.layer LEFT JOIN {t}ranges g ON g.layer = l.layer AND g.cls = c.cls),
{t}k AS (SELECT *, 1 / ({var0})::double AS s, ({width})::double AS w FROM {t}f),
{t}v AS (SELECT *, 1 / ({_KERNEL_SQL[spec.cert_fun_name]})::double AS v0 FROM {t}k),
{t}theme AS (SELECT iy, ix, layer::int AS layer, (CASE {on}WHEN {mask} THEN 100000 ELSE coalesce(CASE WHEN isnan(v0) THEN NULL ELSE v0 END, 100000) END)::double AS variance FROM {t}v)"""


def theme_frame(name: str, spark, d) -> DataFrame:
    spec = themes.resolve_theme_spec(name, N_PREREQ, _THEMES[name][0])
    return themes.build_theme(obs(spark, d), spec, GX, GY, X.LAYERS, cells(spark, d), attrs(spark, d))


def theme_sql(name: str, t: str = "") -> str:
    params, var0, width, mask, fills = _THEMES[name]
    return _theme_ctes(themes.resolve_theme_spec(name, N_PREREQ, params), var0, width, mask, fills, params.get("active_layers"), t)


def _add_theme(name: str) -> None:
    def run(spark, d):
        return theme_frame(name, spark, d).select("iy", "ix", "layer", shown(F.col("variance")).alias("variance"))

    query(f"WITH {theme_sql(name)} SELECT iy, ix, layer, {shown_sql('variance')} AS variance FROM theme", f"theme_{name}")(run)


for _n in _THEMES:
    _add_theme(_n)


def _add_kernel(name: str) -> None:
    src = "SELECT pid, thick * 4 AS d, depth AS w, CASE WHEN pid % 9 = 0 THEN NULL ELSE 100 + depth END AS r, CASE WHEN pid % 21 = 0 THEN cast('Infinity' AS double) ELSE 1 / thick END AS s FROM ({}) p"

    def run(spark, d):
        p = obs(spark, d)
        s = F.when(F.col("pid") % 21 == 0, F.lit(float("inf"))).otherwise(1 / F.col("thick"))
        r = F.when(F.col("pid") % 9 != 0, 100 + F.col("depth"))
        cert = kernels.certainty_function(name)(F.col("thick") * 4, r, F.col("depth"), s)
        return p.select("pid", shown(cert, 9).alias("certainty"))

    sql = f"WITH k AS ({src.format(X.POINTS)}), c AS (SELECT pid, ({_KERNEL_SQL[name]})::double AS c FROM k) SELECT pid, {shown_sql('CASE WHEN isnan(c) THEN NULL ELSE c END', 9)} AS certainty FROM c"
    query(sql, "kernel_" + name.split("_")[0].lower() + ("_" + name.split("_")[1][:3] if name.startswith("ILM") else ""))(run)


for _n in _KERNEL_SQL:
    _add_kernel(_n)

_DRONE = {
    "name": "droneTEM", "search_radius": 4, "cert_fun": "ILM_sep2023", "combine": "nearest", "attributes": {"depth": "mean", "thick": "min", "doi": "mean"},
    "range_model": [{"layers": "all", "range_by_complexity": [50, 300, 250, 150, 80]}],
    "var0": "(0.5 * 1.2 * thick)**2 + where(depth < 10, 4, 0)", "kernel": "maximum(depth, 60)", "mask": "doi < depth", "active_layers": [0, 1],
}


@query(f"WITH {_theme_ctes(themes.load_spec(_DRONE), 'pow(0.6 * thick, 2) + CASE WHEN depth < 10 THEN 4 ELSE 0 END', 'CASE WHEN depth IS NOT NULL THEN greatest(depth, 60) END', 'doi < depth', {}, [0, 1])} SELECT iy, ix, layer, {shown_sql('variance')} AS variance FROM theme")
def theme_from_yaml_expression(spark, d):
    out = themes.build_theme(obs(spark, d), themes.load_spec(_DRONE), GX, GY, X.LAYERS, cells(spark, d), attrs(spark, d))
    return out.select("iy", "ix", "layer", shown(F.col("variance")).alias("variance"))


_EXPRESSIONS = {
    "a": ("maximum(depth, doi) - minimum(thick, doi)", "CASE WHEN doi IS NOT NULL THEN greatest(depth, doi) - least(thick, doi) END"),
    "b": ("where(doi < depth, sqrt(depth), log10(thick) + exp(-thick))", "CASE WHEN doi < depth THEN sqrt(depth) ELSE log10(thick) + exp(-thick) END"),
    "c": ("-depth % 7 + depth // 4 + abs(thick - 9) ** 2", "-depth - 7 * floor(-depth / 7) + floor(depth / 4) + pow(abs(thick - 9), 2)"),
    "d": ("clip(depth / mep_type, 0, 50)", "least(CASE WHEN mep_type = 0 THEN cast('Infinity' AS double) ELSE depth / mep_type END, 50)"),
}


@query(f"SELECT pid, {', '.join(f'round({s}, 6) AS {k}' for k, (_, s) in _EXPRESSIONS.items())} FROM ({X.POINTS}) p")
def expression_language(spark, d):
    names = ["depth", "thick", "doi", "mep_type"]
    cols = {n: F.col(n) for n in names}
    return obs(spark, d).select("pid", *(F.round(expressions.compile_expr(e, names)(cols), 6).alias(k) for k, (e, _) in _EXPRESSIONS.items()))


# ---- wells
_WELL_WINDOW = f"w.x > 500050 + 100 * greatest(0, c.ix - 6) AND w.x < 500050 + 100 * least({X.SIDE - 1}, c.ix + 6) AND w.y > 6100050 + 100 * greatest(0, c.iy - 6) AND w.y < 6100050 + 100 * least({X.SIDE - 1}, c.iy + 6)"


@query(f"""WITH cells AS ({X.CELLS}), w AS (SELECT w.*, t.k, t.gradient, [100, 500, 400, 250, 100][coalesce(w.cls, 0) + 1]::double AS r FROM ({X.WELLS}) w JOIN ({X.TABLES}) t ON t.source = w.source AND t.quality = w.quality),
top AS (SELECT c.iy, c.ix, w.layer, sqrt((w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y)) AS d, 1 / (k * k + pow(gradient * depth, 2)) AS s, r FROM cells c JOIN w ON {_WELL_WINDOW}
  QUALIFY row_number() OVER (PARTITION BY w.layer, w.source, c.iy, c.ix ORDER BY d, w.wid) <= 3),
p AS (SELECT iy, ix, layer, sum(s * exp(-3 * d * d / (r * r))) AS p FROM top GROUP BY ALL)
SELECT c.iy, c.ix, l.layer::int AS layer, {shown_sql("CASE WHEN p.p > 0 THEN 1 / p.p ELSE 100000 END")} AS variance
FROM cells c CROSS JOIN (SELECT unnest(range(3)) AS layer) l LEFT JOIN p ON p.iy = c.iy AND p.ix = c.ix AND p.layer = l.layer""")
def well_theme_top3(spark, d):
    out = wells.build_well_theme(X.frame(spark, d, X.WELLS), X.frame(spark, d, X.TABLES), GX, GY, 3, cells(spark, d))
    return out.select("iy", "ix", "layer", shown(F.col("variance")).alias("variance"))


@query(f"""WITH w AS ({X.WELLS}), z AS (SELECT *, row_number() OVER (ORDER BY wid) AS k FROM w WHERE zero_thickness), a AS (SELECT quality AS q, row_number() OVER (ORDER BY wid) AS k FROM w),
c AS (SELECT cast(ceil((x - 500050) / 100) - 1 AS int) AS ix, cast(ceil((y - 6100050) / 100) - 1 AS int) AS iy, q, k FROM z JOIN a USING (k))
SELECT iy, ix, arg_max(q, k) AS quality FROM c WHERE ix BETWEEN 0 AND 24 AND iy BETWEEN 0 AND 24 GROUP BY iy, ix""")
def tie_map_quality(spark, d):
    return wells.tie_map(X.frame(spark, d, X.WELLS), GX, GY)


@query(f"""WITH w AS ({X.WELLS}), s AS (SELECT * FROM w WHERE source = 'snapped' QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY wid) = 1)
SELECT wid, x, y FROM (SELECT * FROM w WHERE source = 'database' QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY wid) = 1) b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.x = b.x AND s.y = b.y)""")
def well_preparation(spark, d):
    w = X.frame(spark, d, X.WELLS)
    return wells.prepare_wells(w.where("source = 'snapped'"), w.where("source = 'database'"))[1].select("wid", "x", "y")


# ---- background, combination, floor
_MODEL = f"""bot AS (SELECT * FROM ({X.BOTTOMS}) b WHERE layer < {X.LAYERS}), mcells AS ({X.CELLS}),
mt AS (SELECT b.iy, b.ix, b.layer, c.terrain - b.bottom AS x, c.terrain, b.bottom, CASE c.cls WHEN 0 THEN 20.0 WHEN 1 THEN 20.0 WHEN 2 THEN 12.5 WHEN 3 THEN 12.5 ELSE 11.25 END::double AS f FROM bot b JOIN mcells c USING (iy, ix)),
prior AS (SELECT iy, ix, layer, pow(0.5 * CASE WHEN x < 50 THEN 0.3 * x + f ELSE 0.15 * x + 7.5 + f END, 2) AS variance, pow(0.01 * x, 2) AS low FROM mt)"""


def background(spark, d) -> DataFrame:
    return combine.model_theme(bottoms(spark, d), cells(spark, d), class_fmin=combine.DANISH_CLASS_FMIN, depth_ramp=combine.DANISH_DEPTH_RAMP)


@query(f"WITH {_MODEL} SELECT iy, ix, layer, round(variance, 6) AS variance FROM prior")
def model_theme_ramp(spark, d):
    return background(spark, d).select("iy", "ix", "layer", F.round("variance", 6).alias("variance"))


@query(f"WITH {_MODEL} SELECT iy, ix, layer, round(low, 6) AS minimum FROM prior")
def minimum_map(spark, d):
    return combine.minimum_map(bottoms(spark, d), cells(spark, d)).select("iy", "ix", "layer", F.round("minimum", 6).alias("minimum"))


@query(f"SELECT iy, ix, layer::int AS layer, ([4.0, 9.0, 2.5][layer + 1])::double AS variance FROM ({X.CELLS}) c CROSS JOIN (SELECT unnest(range(3)) AS layer)")
def constant_prior(spark, d):
    return combine.constant_prior(cells(spark, d), [4.0, 9.0, 2.5])


_TWO = ("fewtem", "manytem")


_BOTH = f"{theme_sql('fewtem', 'a_')}, {theme_sql('manytem', 'b_')}"
_PRIOR_SUM = f"""WITH {_BOTH}, {_MODEL},
u AS (SELECT iy, ix, layer, variance FROM a_theme UNION ALL SELECT iy, ix, layer, variance FROM b_theme UNION ALL SELECT iy, ix, layer, variance FROM prior),
comb AS (SELECT iy, ix, layer, CASE WHEN count(variance) = count(*) THEN 1 / sum(1 / variance) END AS variance FROM u GROUP BY ALL)"""


@query(f"{_PRIOR_SUM} SELECT iy, ix, layer, {shown_sql('variance')} AS variance FROM comb")
def combine_with_prior(spark, d):
    two = [theme_frame(n, spark, d) for n in _TWO]
    return combine.combine_variances(two, prior=background(spark, d)).select("iy", "ix", "layer", shown(F.col("variance")).alias("variance"))


@query(f"""WITH {_BOTH}, u AS (SELECT * FROM a_theme UNION ALL SELECT * FROM b_theme),
comb AS (SELECT iy, ix, layer, CASE WHEN count(variance) = count(*) THEN 1 / sum(1 / variance) END AS variance, coalesce(bool_or(variance < 100000), false) AS informed FROM u GROUP BY ALL)
SELECT layer, count(*) FILTER (WHERE NOT informed OR variance IS NULL OR variance >= 100000) AS n_suspect, round(sum(CASE WHEN variance < 1e6 THEN variance END), 3) AS total FROM comb GROUP BY layer""")
def combine_no_prior_suspect_count(spark, d):
    both = [theme_frame(n, spark, d) for n in _TWO]
    c = combine.combine_variances(both, prior=None, warn=False)
    v = F.col("variance")
    total = c.groupBy("layer").agg(F.round(F.sum(F.when(v < 1e6, v)), 3).alias("total"))
    return combine.suspect_count(both).join(total, "layer")


@query(f"WITH {_BOTH} SELECT iy, ix, layer, coalesce(bool_or(variance < 100000), false) AS informed FROM (SELECT * FROM a_theme UNION ALL SELECT * FROM b_theme) GROUP BY ALL")
def informed_mask(spark, d):
    return combine.informed_mask([theme_frame(n, spark, d) for n in _TWO])


_FLAG = f"{_PRIOR_SUM} SELECT c.iy, c.ix, c.layer, {shown_sql('CASE WHEN c.variance < p.low THEN p.low ELSE c.variance END')} AS variance FROM comb c LEFT JOIN prior p USING (iy, ix, layer)"


@query(_FLAG)
def flagship(spark, d):
    two = [theme_frame(n, spark, d) for n in _TWO]
    out = combine.apply_floor(combine.combine_variances(two, prior=background(spark, d)), combine.minimum_map(bottoms(spark, d), cells(spark, d)))
    return out.select("iy", "ix", "layer", shown(F.col("variance")).alias("variance"))


@query(f"WITH {_MODEL} SELECT iy, ix, layer, round(CASE WHEN variance / 4000 < low THEN low ELSE variance / 4000 END, 6) AS variance FROM prior")
def floor(spark, d):
    v = background(spark, d).withColumn("variance", F.col("variance") / 4000)
    out = combine.apply_floor(v, combine.minimum_map(bottoms(spark, d), cells(spark, d)))
    return out.select("iy", "ix", "layer", F.round("variance", 6).alias("variance"))


@query(f"WITH b AS (SELECT * FROM ({X.BOTTOMS}) b WHERE layer < {X.LAYERS}) SELECT b.iy, b.ix, layer, terrain - bottom AS depth, CASE WHEN layer = 0 THEN terrain ELSE lag(bottom) OVER (PARTITION BY b.iy, b.ix ORDER BY layer) END - bottom AS thick FROM b JOIN ({X.CELLS}) c ON c.iy = b.iy AND c.ix = b.ix")
def depth_and_thickness(spark, d):
    return grid.depth_and_thickness(bottoms(spark, d), cells(spark, d).select("iy", "ix", F.col("terrain").alias("value"))).select("iy", "ix", "layer", "depth", "thick")


# ---- cleaning
@query(f"WITH p AS ({X.POINTS}), m AS (SELECT avg(doi) AS m FROM p) SELECT pid, round(CASE WHEN doi IS NOT NULL THEN doi WHEN thick >= 10 THEN CASE WHEN top IS NOT NULL THEN least(m, top) END ELSE m END, 6) AS doi FROM (SELECT *, CASE WHEN pid % 3 = 0 THEN NULL ELSE depth END AS top FROM p), m")
def doi_resolution(spark, d):
    p = obs(spark, d).withColumn("top", F.when(F.col("pid") % 3 != 0, F.col("depth")))
    return clean.resolve_doi(p, horizon_top="top", horizon_thickness="thick").select("pid", F.round("doi", 6).alias("doi"))


@query(f"SELECT pid, yr FROM ({X.POINTS}) p WHERE yr <= 1996")
def temporal_filter(spark, d):
    return clean.temporal_filter(obs(spark, d), 1996, "yr").select("pid", "yr")


@query(f"SELECT x, y, max(pid) AS pid FROM ({X.POINTS}) p GROUP BY x, y")
def dedup_keep_last(spark, d):
    return clean.dedup_keep_last(obs(spark, d)).select("x", "y", "pid")


@query(f"WITH p AS ({X.POINTS}) SELECT pid, 0::int AS layer, depth, doi FROM p UNION ALL SELECT pid, 1, depth + thick, doi FROM p UNION ALL SELECT pid, 2, depth * 2, doi FROM p")
def wide_to_layers(spark, d):
    w = obs(spark, d).select("pid", "doi", F.col("depth").alias("depth__L01"), (F.col("depth") + F.col("thick")).alias("depth__L02"), (F.col("depth") * 2).alias("depth__L03"))
    return clean.wide_to_layers(w, {"depth": {"per_layer": True, "prefix": "depth__L"}, "doi": {"column": "doi"}}, 3)


# ---- neighbourhoods and point drawing
def surface(spark, d):
    return X.frame(spark, d, X.SURFACE)


_P = {"P0": 0.05, "L0": 2.0, "A": 0.5, "B": 1.0, "C": 4.0, "D": 2.0, "E": 1.0, "g": 1.5, "x0": 500000.0, "y0": 6100000.0}
_LAP = f"""s AS ({X.SURFACE}), l AS (SELECT m.iy, m.ix,
  (x1.value + x0.value - 2 * xm.value + y1.value + y0.value - 2 * ym.value) / 4 AS lap FROM s m
  JOIN s xm ON xm.iy = m.iy AND xm.ix = least(greatest(m.ix, 1), 23) JOIN s x0 ON x0.iy = m.iy AND x0.ix = xm.ix - 1 JOIN s x1 ON x1.iy = m.iy AND x1.ix = xm.ix + 1
  JOIN s ym ON ym.ix = m.ix AND ym.iy = least(greatest(m.iy, 1), 23) JOIN s y0 ON y0.ix = m.ix AND y0.iy = ym.iy - 1 JOIN s y1 ON y1.ix = m.ix AND y1.iy = ym.iy + 1)"""


@query(f"WITH {_LAP} SELECT iy, ix, round(lap, 6) AS laplacian FROM l")
def laplacian_edges(spark, d):
    return neighbourhood.laplacian(surface(spark, d), X.SIDE, X.SIDE).select("iy", "ix", F.round("laplacian", 6).alias("laplacian"))


@query(f"""WITH {_LAP}, w AS (SELECT cast(floor((x - 500000) / 100) AS int) AS ix, cast(floor((y - 6100000) / 100) AS int) AS iy, count(*) AS n FROM ({X.WELLS}) w GROUP BY ALL),
t AS (SELECT iy, ix, abs(lap) AS lap, CASE WHEN abs(lap) < 2 THEN 4 * 0.05 / 2 * (tanh((abs(lap) - 1) * 1.5) + 1) ELSE 6 * 0.05 / ((abs(lap) - 2) * (abs(lap) - 2) / 2 + 1) - 2 * 0.05 END + 0.05 AS f FROM l),
g AS (SELECT *, f + CASE WHEN (24 - iy) % 10 = 0 AND ix % 10 = 0 THEN 1 ELSE 0 END AS p FROM t), m AS (SELECT avg(p) AS m FROM g)
SELECT g.iy, g.ix, round(f, 6) AS transfer, round(least(CASE WHEN m > 1 THEN p / m ELSE p END + coalesce(n, 0), 1), 6) AS probability FROM m, g LEFT JOIN w ON w.iy = g.iy AND w.ix = g.ix""")
def inpox_probability(spark, d):
    p = points.draw_probability(surface(spark, d), X.SIDE, X.SIDE, _P, 100.0, 100.0, X.frame(spark, d, X.WELLS).select("x", "y"))
    return p.select("iy", "ix", F.round("transfer", 6).alias("transfer"), F.round("probability", 6).alias("probability"))


@query()
def inpox_draw(spark, d):
    return points.draw_points(points.draw_probability(surface(spark, d), X.SIDE, X.SIDE, _P), 7)


@query(f"WITH s AS ({X.SURFACE}), p AS (SELECT * FROM s WHERE (ix * 3 + iy) % 5 = 0) SELECT c.iy, c.ix, round(avg(p.value), 6) AS mean, round(var_pop(p.value), 6) AS sill, count(*) AS n FROM s c JOIN p ON abs(p.iy - c.iy) <= 4 AND abs(p.ix - c.ix) <= 4 GROUP BY c.iy, c.ix")
def window_mean_sill(spark, d):
    s = surface(spark, d)
    out = neighbourhood.window_mean_sill(s, s.where("(ix * 3 + iy) % 5 = 0"), s, 4)
    return out.select("iy", "ix", F.round("mean", 6).alias("mean"), F.round("sill", 6).alias("sill"), "n")


@query(X.duck(f"""WITH c AS ({X.CLASSES}), n AS (SELECT a.iy, a.ix, b.cls, count(*) AS n FROM c a JOIN c b ON b.cls IS NOT NULL AND abs(a.iy - b.iy) <= 4 AND abs(a.ix - b.ix) <= 4 GROUP BY ALL),
m AS (SELECT iy, ix, arg_min(cls, (-n, cls)) AS mode, max(n) AS mn, sum(n) AS total FROM n GROUP BY iy, ix)
SELECT c.iy, c.ix, CASE WHEN cls IS NOT NULL AND total > 10 AND mn > 0.2 * total THEN mode ELSE cls END AS cls FROM c LEFT JOIN m USING (iy, ix)"""))
def mode_cleanup(spark, d):
    return neighbourhood.mode_cleanup(X.frame(spark, d, X.CLASSES))


@query(f"WITH c AS ({X.CELLS}), l AS (SELECT * FROM c WHERE cls = 4 AND ix > 9) SELECT c.iy, c.ix, arg_min(l.ix * 100 + l.iy, ((l.iy - c.iy) * (l.iy - c.iy) + (l.ix - c.ix) * (l.ix - c.ix), l.iy, l.ix)) AS label FROM c JOIN l ON true WHERE NOT (c.cls = 4 AND c.ix > 9) GROUP BY c.iy, c.ix")
def nearest_label_fill(spark, d):
    c = cells(spark, d)
    lab = c.where("cls = 4 and ix > 9").select("iy", "ix", (F.col("ix") * 100 + F.col("iy")).alias("label"))
    return neighbourhood.nearest_label(lab, c.where("not (cls = 4 and ix > 9)"))


@query(f"WITH s AS ({X.SURFACE}), g AS (SELECT y.i AS iy, x.i AS ix FROM (SELECT unnest(range(-3, 28)) AS i) y CROSS JOIN (SELECT unnest(range(-3, 28)) AS i) x) SELECT g.iy::int AS iy, g.ix::int AS ix, value FROM g JOIN s ON s.iy = least(abs(g.iy), 48 - abs(g.iy)) AND s.ix = least(abs(g.ix), 48 - abs(g.ix))")
def reflect_pad(spark, d):
    return neighbourhood.reflect_pad(surface(spark, d), X.SIDE, X.SIDE, 3)


# ---- clusters
@query(f"WITH e AS ({X.ESTIMATES}), p AS (SELECT quantile_disc(range, 0.5) AS pr, quantile_disc(sill, 0.95) AS ps FROM e WHERE range IS NOT NULL AND sill IS NOT NULL), o AS (SELECT label, quantile_disc(range, 0.5) AS r, quantile_disc(sill, 0.95) AS s FROM e GROUP BY label) SELECT label, coalesce(r, pr) AS range, CASE WHEN r IS NULL THEN ps ELSE s END AS sill FROM o, p")
def cluster_stats_nearest_rank(spark, d):
    return clusters.cluster_stats(X.frame(spark, d, X.ESTIMATES))


_NODES = [[0.0, 0.1], [0.2, -0.1], [-0.3, 0.3], [0.1, 0.1]]


@query("SELECT vec_id, list_position(a, list_min(a))::int AS node FROM (SELECT vec_id, [" + ", ".join(f"pow(embedding[1]::double - {a}::double, 2) + pow(embedding[2]::double - {b}::double, 2)" for a, b in _NODES) + "] AS a FROM embeddings)")
def som_predict(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    f = [F.get("embedding", F.lit(k)).cast("double") for k in (0, 1)]
    return e.select("vec_id", clusters.som_predict(_NODES, f).alias("node"))


@query(f"""WITH RECURSIVE m AS ({X.MARKED}), r(iy, ix, root) AS (SELECT iy, ix, iy * 25 + ix FROM m UNION SELECT m.iy, m.ix, r.root FROM r JOIN m ON abs(m.iy - r.iy) + abs(m.ix - r.ix) = 1),
t AS (SELECT iy, ix, min(root) AS root FROM r GROUP BY iy, ix) SELECT iy, ix, dense_rank() OVER (ORDER BY root)::int AS component FROM t""")
def connected_components(spark, d):
    m = X.frame(spark, d, X.MARKED).withColumn("zone", F.lit(1))
    return kriging.connected_components(m, ["zone"], 4, tile=8).select("iy", "ix", "component")


# ---- stacking
def reals(spark, d):
    return X.frame(spark, d, X.REALS)


_STACK = f"WITH r AS ({X.REALS}), s AS (SELECT iy, ix, layer, real, elevation, min(elevation) OVER (PARTITION BY iy, ix, real ORDER BY layer) AS e FROM r)"


@query(f"{_STACK} SELECT iy, ix, real, layer AS boundary, e AS elevation, e IS DISTINCT FROM elevation AS moved FROM s")
def stack_clamp(spark, d):
    return stacking.stack_realizations(reals(spark, d))


@query(f"{_STACK} SELECT iy, ix, layer AS boundary, round(CASE WHEN count(e) = count(*) THEN avg(e) END, 6) AS mean FROM s GROUP BY iy, ix, layer")
def ensemble_mean(spark, d):
    return stacking.ensemble_mean(stacking.stack_realizations(reals(spark, d))).withColumn("mean", F.round("mean", 6))


@query(f"{_STACK} SELECT layer AS boundary, count(*) FILTER (WHERE e IS DISTINCT FROM elevation) AS n_clamped FROM s GROUP BY layer")
def clamp_counts(spark, d):
    return stacking.clamp_counts(stacking.stack_realizations(reals(spark, d)))


@query(f"SELECT 's' || layer AS name, iy, ix, CASE WHEN layer = 0 THEN bottom ELSE bottom - 2 END AS value FROM ({X.BOTTOMS}) b")
def perturb_shift(spark, d):
    b = X.frame(spark, d, X.BOTTOMS).select(F.concat(F.lit("s"), "layer").alias("name"), "iy", "ix", F.col("bottom").alias("value"))
    return stacking.perturb_shift(b, 2.0, ["s0"])


@query(f"""WITH r AS ({X.REALS}), t AS (SELECT iy, ix FROM ({X.CELLS}) c WHERE (ix * 3 + iy * 7) % 29 = 0), w AS (SELECT c.iy, c.ix, exp(-min((t.iy - c.iy) * (t.iy - c.iy) + (t.ix - c.ix) * (t.ix - c.ix)) / 3.0::double) AS w
  FROM ({X.CELLS}) c JOIN t ON (t.iy - c.iy) * (t.iy - c.iy) + (t.ix - c.ix) * (t.ix - c.ix) <= 16 GROUP BY c.iy, c.ix)
SELECT b.iy, b.ix, b.real, round(CASE WHEN w IS NULL THEN b.elevation ELSE w * u.elevation + (1 - w) * b.elevation END, 6) AS elevation FROM r b JOIN r u ON u.iy = b.iy AND u.ix = b.ix AND u.real = b.real AND u.layer = 0 LEFT JOIN w ON w.iy = b.iy AND w.ix = b.ix WHERE b.layer = 1""")
def tie_realizations(spark, d):
    r = reals(spark, d)
    t = cells(spark, d).where("(ix * 3 + iy * 7) % 29 = 0")
    return stacking.tie_realizations(r.where("layer = 0"), r.where("layer = 1").drop("layer"), t).withColumn("elevation", F.round("elevation", 6))


# ---- kriging
_RESULTS = f"""SELECT 0 AS layer, cast(r_regionkey as int) as label, 1 as component, iy, ix, cast(1 + (ix + r_regionkey) % 3 as double) / 4 as weight,
  cast(terrain - r_regionkey as double) as mean, cast(1 + (iy + r_regionkey) % 4 as double) as std, array(cast(ix - r_regionkey as double), cast(iy + r_regionkey as double)) as reals
from ({X.CELLS}) c cross join region where r_regionkey < 3 and (ix + r_regionkey) % 5 > 0"""


@query(f"""WITH q AS ({_RESULTS.replace("array(", "list_value(")}), s AS (SELECT iy, ix, sum(weight) AS w, sum(weight * mean) AS m, sum(weight * std) AS sd, sum(pow(weight * std, 2)) AS v, sum(weight * reals[1]) AS r1, sum(weight * reals[2]) AS r2 FROM q GROUP BY iy, ix)
SELECT iy, ix, round(m / w, 6) AS mean, round(sd / w, 6) AS post_std, round(sqrt(v) / sd, 6) AS deflation, round(r1 / w / (sqrt(v) / sd), 6) AS r1, round(r2 / w / (sqrt(v) / sd), 6) AS r2 FROM s""")
def blend_windows(spark, d):
    b = kriging.blend(X.frame(spark, d, _RESULTS))
    return b.select("iy", "ix", *(F.round(c, 6).alias(c) for c in ("mean", "post_std", "deflation")), *(F.round(F.get("reals", F.lit(k)), 6).alias(f"r{k + 1}") for k in (0, 1)))


_V = geostat.parse_variogram("2.5 Sph(400) + 1.5 Gau(700) + 0.5 Exp(300)")


@query(f"""WITH c AS ({X.CELLS}), p AS (SELECT a.iy * 25 + a.ix AS a, b.iy * 25 + b.ix AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM c a CROSS JOIN c b)
SELECT a, b, round(4.5 - (2.5 * CASE WHEN d < 400 THEN 1.5 * d / 400 - 0.5 * pow(d / 400, 3) ELSE 1 END + 1.5 * (1 - exp(-3 * d * d / 490000)) + 0.5 * (1 - exp(-3 * d / 300))), 6) AS covariance FROM p""")
def pairwise_covariance(spark, d):
    c = cells(spark, d).select((F.col("iy") * 25 + F.col("ix")).alias("k"), "x", "y")
    p = c.select(F.col("k").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya")).crossJoin(F.broadcast(c.select(F.col("k").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))))
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return p.select("a", "b", F.round(geostat.covariance_column(_V, F.sqrt(dx * dx + dy * dy)), 6).alias("covariance"))


def _windows(spark, d):
    s = surface(spark, d).withColumn("layer", F.lit(0))
    lab = s.select("layer", "iy", "ix", F.when((F.col("ix") < 12) | (F.col("iy") > 15), 1).otherwise(2).alias("label"))
    stats = spark.createDataFrame([(0, 1, 400.0), (0, 2, 250.0)], "layer int, label int, range double")
    cond = s.where("(ix * 7 + iy * 3) % 6 = 0")
    mt = s.select("layer", "iy", "ix", (F.lit(4.0) + F.col("iy") / 10).alias("variance"))
    g = kriging.pack_grid(s.withColumn("value", F.col("value") - 68), mt.withColumn("variance", F.lit(0.25)))
    return g, kriging.build_windows(lab, s, cond, stats, mt, X.SIDE, X.SIDE)


def _ring_ctes(name: str, inside: str) -> str:
    """``{name}0`` to ``{name}3``: the number of the ring outside ``inside`` that each cell of each element lies in."""
    cte = f"{name}0 AS (SELECT label, iy, ix, {inside} AS v, 0 AS ring FROM m)"
    for k in (1, 2, 3):
        cte += f""",
{name}{k} AS (SELECT label, iy, ix, v OR e AS v, CASE WHEN e THEN {k} ELSE ring END AS ring FROM (SELECT *, NOT v AND
    (coalesce(lag(v) OVER x, v) <> coalesce(lead(v) OVER x, v) OR coalesce(lag(v) OVER y, v) <> coalesce(lead(v) OVER y, v)) AS e FROM {name}{k - 1}
  WINDOW x AS (PARTITION BY label, iy ORDER BY ix), y AS (PARTITION BY label, ix ORDER BY iy)))"""
    return cte


_BUFFER_SQL = f"""
WITH m AS (SELECT label, iy, ix, (CASE WHEN ix < 12 OR iy > 15 THEN 1 ELSE 2 END) = label AS v FROM ({X.CELLS}) c, (VALUES (1), (2)) l(label)),
{_ring_ctes("a", "v")},
{_ring_ctes("b", "NOT v")},
w AS (SELECT label, iy, ix, CASE WHEN m.v THEN CASE b3.ring WHEN 0 THEN 1 ELSE (3 + b3.ring) / 7.0 END ELSE CASE a3.ring WHEN 0 THEN 0 ELSE (4 - a3.ring) / 7.0 END END::double AS w
  FROM m JOIN a3 USING (label, iy, ix) JOIN b3 USING (label, iy, ix))
SELECT label, 1 AS component, iy, ix, round(w, 6) AS weight FROM w WHERE w > 0"""


@query(_BUFFER_SQL)
def buffer_weights(spark, d):
    return _windows(spark, d)[1].select("label", "component", "iy", "ix", F.round("weight", 6).alias("weight"))


@query()
def krige_window(spark, d):
    g, w = _windows(spark, d)
    return kriging.krige(g, w).select("label", "component", "iy", "ix", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def simulate_layer(spark, d):
    g, w = _windows(spark, d)
    return kriging.simulate_layers(g, w, 4, seed=3)


_REACH_SQL = f"""
WITH c AS ({X.duck(X.CLASSES)}),
h AS (SELECT iy, ix, cls FROM c WHERE cls IS NOT NULL AND ix < 9),
o AS (SELECT iy, ix FROM c WHERE cls IS NULL OR ix >= 9),
r AS (SELECT o.iy, o.ix, greatest(5, min(greatest(abs(o.iy - h.iy), abs(o.ix - h.ix)))) AS r FROM o CROSS JOIN h GROUP BY ALL),
n AS (SELECT r.iy, r.ix, h.cls, count(*) AS n FROM r JOIN h ON abs(r.iy - h.iy) <= r AND abs(r.ix - h.ix) <= r GROUP BY ALL)
SELECT iy, ix, arg_min(cls, (-n, cls)) AS cls FROM n GROUP BY iy, ix"""


@query(_REACH_SQL)
def reach_fill(spark, d):
    c = X.frame(spark, d, X.CLASSES)
    known = F.expr("cls is not null and ix < 9")
    return clusters.mode_within_reach(c.where(known), c.where(~known), 5, X.SIDE, X.SIDE)


@query()
def kriging_zones(spark, d):
    s = surface(spark, d).withColumn("range", F.when(F.pmod(F.col("ix") * 3 + F.col("iy"), F.lit(4)) == 0, 100.0 + 10 * F.col("ix"))).withColumn("sill", F.when(F.col("range").isNotNull(), 1.0 + F.col("iy")))
    return clusters.build_zones(s, X.SIDE, X.SIDE, max_cluster_size=150)[0]


@query()
def range_sill_surface(spark, d):
    s = surface(spark, d)
    out = rangesill.estimate_surface(s, s.where("(ix * 7 + iy * 3) % 6 = 0"), X.SIDE, X.SIDE, rangesill.VariogramEstimator(9), minigrid_size=11)
    return out.select("iy", "ix", *(F.round(c, 6).alias(c) for c in ("range", "sill", "lf_mean", "residual")))


# ---- further grid, filter and assembly operators
_META = grid.GridMeta.of({"ncols": X.SIDE, "nrows": X.SIDE, "cellsize": 100, "xllcorner": 500000, "yllcorner": 6100000})


@query("SELECT y.i::int AS iy, x.i::int AS ix, 500000 + 100 * (x.i + 0.5::double) AS x, 6100000 + 100 * (y.i + 0.5::double) AS y FROM (SELECT unnest(range(25)) AS i) y CROSS JOIN (SELECT unnest(range(25)) AS i) x")
def cell_centres(spark, d):
    return _META.cells(spark)


@query(f"WITH s AS ({X.SURFACE}) SELECT pid, value FROM ({X.POINTS}) p JOIN s ON s.ix = greatest(0, least(24, cast(trunc((p.x - 500050) / 100 + 0.5) AS int))) AND s.iy = greatest(0, least(24, cast(trunc((p.y - 6100050) / 100 + 0.5) AS int)))")
def sample_at_points(spark, d):
    return grid.sample_at(obs(spark, d), surface(spark, d), _META).select("pid", "value")


@query(f"WITH c AS ({X.CELLS}) SELECT iy, ix, CASE WHEN k < -1 THEN 0 ELSE coalesce(k, 0) END AS cls FROM (SELECT c.iy, c.ix, t.cls - 3 AS k FROM c LEFT JOIN c t ON t.x - 50 + 50 = c.x AND t.y - 50 + 50 = c.y AND t.ix < 20)")
def complexity_import(spark, d):
    c = cells(spark, d)
    t = c.where("ix < 20").select((F.col("x") - 50).alias("x"), (F.col("y") - 50).alias("y"), (F.col("cls") - 3).alias("cls"))
    return grid.import_classes(c, t)


@query(f"SELECT pid, round((x - 500000) / 100 + 1, 6) AS xn, round((y - 6100000) / 100 + 1, 6) AS yn FROM ({X.POINTS}) p WHERE x BETWEEN 500500 AND 501500 AND y BETWEEN 6100200 AND 6101000")
def bbox_and_normalised_coordinates(spark, d):
    p = grid.normalize_coordinates(wells.bbox(obs(spark, d), 500500, 501500, 6100200, 6101000), 500000, 6100000, 100, 100)
    return p.select("pid", F.round("xn", 6).alias("xn"), F.round("yn", 6).alias("yn"))


@query(f"SELECT pid, CASE WHEN yr = 1995 THEN 2017 ELSE yr END AS year FROM ({X.POINTS}) p WHERE CASE WHEN yr = 1995 THEN 2017 ELSE yr END BETWEEN 1001 AND 2017 AND yr <> 1996")
def well_date_filter(spark, d):
    p = obs(spark, d).select("pid", F.when(F.col("yr") == 1995, 2107).when(F.col("yr") == 1996, 0).otherwise(F.col("yr")).alias("year"))
    return wells.date_filter(p, 2017)


_MASK = f"SELECT iy, ix, CASE WHEN iy BETWEEN 6 AND 17 AND ix BETWEEN 4 AND 15 AND (ix * iy) % 11 > 0 THEN 1 ELSE 0 END AS value FROM ({X.CELLS}) c"


@query(f"""WITH m AS ({_MASK}), g AS (SELECT m.iy, m.ix, m.value,
  abs(CASE WHEN m.ix = 0 THEN e.value - m.value WHEN m.ix = 24 THEN m.value - w.value ELSE (e.value - w.value) / 2 END) + abs(CASE WHEN m.iy = 0 THEN n.value - m.value WHEN m.iy = 24 THEN m.value - s.value ELSE (n.value - s.value) / 2 END) AS g
  FROM m LEFT JOIN m e ON e.iy = m.iy AND e.ix = m.ix + 1 LEFT JOIN m w ON w.iy = m.iy AND w.ix = m.ix - 1 LEFT JOIN m n ON n.ix = m.ix AND n.iy = m.iy + 1 LEFT JOIN m s ON s.ix = m.ix AND s.iy = m.iy - 1)
SELECT iy, ix, g > 0 AND value = 0 AS outer_ring, g > 0 AND value = 1 AS inner_ring FROM g""")
def border_rings(spark, d):
    m = X.frame(spark, d, _MASK)
    a, b = (neighbourhood.border_ring(m, k).withColumnRenamed("border", c) for k, c in (("positive", "outer_ring"), ("negative", "inner_ring")))
    return a.join(b, ["iy", "ix"])


@query(f"WITH s AS (SELECT iy, ix, CASE WHEN (ix + iy) % 6 > 0 THEN value END AS value FROM ({X.SURFACE}) s) SELECT a.iy, a.ix, round(avg(b.value), 6) AS value FROM s a JOIN s b ON abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 3 GROUP BY a.iy, a.ix")
def sliding_mean(spark, d):
    s = surface(spark, d).withColumn("value", F.when((F.col("ix") + F.col("iy")) % 6 > 0, F.col("value")))
    return neighbourhood.smooth(s, 5, 7).withColumn("value", F.round("value", 6))


@query(f"WITH s AS ({X.SURFACE}) SELECT c.iy, c.ix, count(s.value) AS n, sum(s.value * ((s.iy - c.iy + 2) * 5 + s.ix - c.ix + 3)) AS weighted FROM s c JOIN s ON abs(s.iy - c.iy) <= 2 AND abs(s.ix - c.ix) <= 2 WHERE c.ix % 4 = 0 GROUP BY c.iy, c.ix")
def local_patches(spark, d):
    s = surface(spark, d)
    p = neighbourhood.patches(s, s.where("ix % 4 = 0"), 5)
    w = F.aggregate(F.transform("patch", lambda v, k: F.coalesce(v * (k + 1), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    return p.select("iy", "ix", F.size(F.filter("patch", lambda v: v.isNotNull())).cast("long").alias("n"), w.alias("weighted"))


@query(f"WITH e AS ({X.ESTIMATES}) SELECT label, round(quantile_cont(sill, 0.05), 6) AS p05, round(quantile_cont(sill, 0.5), 6) AS p50, round(quantile_cont(sill, 0.95), 6) AS p95 FROM e GROUP BY label")
def percentile_summary(spark, d):
    p = neighbourhood.percentile_summary(X.frame(spark, d, X.ESTIMATES), value="sill")
    return p.select("label", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")))


@query(f"WITH b AS ({X.BOTTOMS}), m AS (SELECT iy, ix, bottom AS v FROM b WHERE layer = 0), g AS (SELECT iy, ix, bottom AS value FROM b WHERE layer = 1) SELECT g.iy, g.ix, round((g.ix % 5) / 4.0::double * coalesce(v, 0) + (1 - (g.ix % 5) / 4.0::double) * coalesce(value, 0), 6) AS value FROM g JOIN m USING (iy, ix)")
def merge_layers(spark, d):
    b = X.frame(spark, d, X.BOTTOMS).withColumn("value", F.col("bottom"))
    w = cells(spark, d).select("iy", "ix", ((F.col("ix") % 5) / 4.0).alias("weight"))
    return stacking.merge_layers(b.where("layer = 0"), b.where("layer = 1"), w).withColumn("value", F.round("value", 6))


@query(f"WITH r AS ({X.REALS}) SELECT iy, ix, real, layer AS boundary, elevation FROM r UNION ALL SELECT iy, ix, real, 5, elevation - 50 FROM r WHERE layer = 4")
def add_bottom(spark, d):
    return stacking.add_bottom(reals(spark, d).withColumnRenamed("layer", "boundary"))


@query(f"WITH b AS ({X.BOTTOMS}), s AS (SELECT iy, ix, layer + 1 AS boundary, real, elevation FROM ({X.REALS}) r UNION ALL SELECT iy, ix, 0, k, terrain FROM ({X.CELLS}) c CROSS JOIN (SELECT unnest(range(4))::int AS k)) SELECT iy, ix, real, boundary, min(elevation) OVER (PARTITION BY iy, ix, real ORDER BY boundary) AS elevation, elevation IS DISTINCT FROM min(elevation) OVER (PARTITION BY iy, ix, real ORDER BY boundary) AS moved FROM s")
def stack_under_terrain(spark, d):
    return stacking.stack_realizations(reals(spark, d), cells(spark, d).withColumn("value", F.col("terrain")))


@query("SELECT k * 10.0::double / 199 AS laplacian, round(CASE WHEN k * 10.0::double / 199 < 2 THEN 0.1::double * (tanh((k * 10.0::double / 199 - 1) * 1.5) + 1) ELSE 0.3::double / (pow(k * 10.0::double / 199 - 2, 2) / 2 + 1) - 0.1 END + 0.05, 6) AS probability FROM (SELECT unnest(range(200)) AS k)")
def inpox_transfer_curve(spark, d):
    return points.transfer_curve(spark, _P).withColumn("probability", F.round("probability", 6))


@query(f"WITH t AS (SELECT 'a' AS tile, iy, ix, layer, bottom AS value FROM ({X.BOTTOMS}) b UNION ALL SELECT 'b', iy, ix, layer, bottom + 1 FROM ({X.BOTTOMS}) b) SELECT iy + oy AS iy, ix + ox AS ix, layer, arg_max_null(value, tile) AS value FROM t JOIN (VALUES ('a', 0, 0), ('b', 20, 25)) o(tile, oy, ox) USING (tile) GROUP BY ALL")
def tile_mosaic(spark, d):
    b = X.frame(spark, d, X.BOTTOMS).select("iy", "ix", "layer", F.col("bottom").alias("value"))
    t = b.withColumn("tile", F.lit("a")).unionByName(b.withColumn("tile", F.lit("b")).withColumn("value", F.col("value") + 1))
    return grid.mosaic(t, spark.createDataFrame([("a", 0, 0), ("b", 20, 25)], "tile string, oy int, ox int"))


@query(f"WITH p AS (SELECT layer, quality AS q, wid, x, y FROM ({X.WELLS}) w) SELECT layer, count(*) AS n, min(wid) AS wid FROM p GROUP BY layer")
def layer_tables(spark, d):
    w = X.frame(spark, d, X.WELLS)
    cols = [F.col("x").alias("X"), F.col("y").alias("Y"), F.col("depth").alias("Z"), F.col("quality").alias("PointType"), F.col("wid").alias("SnapID")]
    t = wells.union_layer_tables([w.where(f"layer = {k}").select(*cols) for k in range(3)])
    return t.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min("SnapID").alias("wid"))


@query()
def range_sill_clusters(spark, d):
    e = X.frame(spark, d, X.ESTIMATES).where("range is not null and sill is not null").select(F.col("range"), F.col("sill"))
    return clusters.cluster_range_sill(e, 4, seed=1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def split_oversized(spark, d):
    return clusters.split_oversized(cells(spark, d).select("iy", "ix", F.when(F.col("ix") < 14, 1).otherwise(2).alias("label")), 100)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
