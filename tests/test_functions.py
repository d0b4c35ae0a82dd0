import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoflow.functions import expressions, geostat, kernels, missing


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 4.0), (2, 6.0)], "g int, v double")
    got = {r[0]: tuple(r)[1:] for r in df.groupBy("g").agg(*(missing.REDUCERS[k](F.col("v")) for k in ("mean", "min", "max"))).collect()}
    assert got == {1: (None, None, None), 2: (5.0, 4.0, 6.0)}
    n = F.lit(None).cast("double")
    assert one(spark, missing.safe_recip(F.lit(0.0)), missing.safe_recip(n), missing.safe_recip(F.lit(math.inf))) == (math.inf, None, 0.0)
    assert one(spark, missing.greatest_prop(F.lit(1.0), n), F.greatest(F.lit(1.0), n), missing.least_prop(F.lit(1.0), F.lit(2.0))) == (None, 1.0, 1.0)
    assert one(spark, missing.safe_divide(F.lit(-1.0), F.lit(0.0)), missing.safe_divide(F.lit(0.0), F.lit(0.0)), missing.no_nan(F.lit(math.nan))) == (-math.inf, None, None)


def test_kernels(spark):
    d, r, w, s = (F.lit(float(v)) for v in (100, 200, 75, 2))
    g = math.exp(-3 * 25**2 / 200**2)
    assert one(spark, kernels.frafa(d, r, w, s))[0] == pytest.approx(2 * g)
    assert one(spark, kernels.ilm_sep(d, r, w, s), kernels.ilm_oct(d, r, w, s)) == (0.0, 0.0)
    inside = one(spark, *(k(F.lit(50.0), r, w, s) for k in (kernels.ilm_sep, kernels.ilm_oct, kernels.rbm)))
    assert inside == pytest.approx((2 * math.exp(-3 * 25**2 / 4e4), 2 * math.exp(-3 * 2500 / 4e4), 2 * math.exp(-1.5 * 2500 / 4e4)))
    n = F.lit(None).cast("double")
    assert one(spark, kernels.frafa(F.lit(50.0), n, w, s), kernels.ilm_sep(F.lit(50.0), n, w, s)) == (2.0, None)
    assert one(spark, kernels.ilm_sep(d, r, w, F.lit(math.inf)))[0] is None
    with pytest.raises(ValueError, match="unknown"):
        kernels.certainty_function("nope")
    with pytest.raises(TypeError):
        kernels.register_certainty_function("k", lambda a, b: a)
    kernels.register_certainty_function("flat", lambda dist, range_, width, sill: sill, overwrite=True)
    with pytest.raises(ValueError, match="already"):
        kernels.register_certainty_function("flat", lambda dist, range_, width, sill: sill)
    numpy = kernels.from_numpy(lambda d, r, w, s: np.where(d <= w, s, s * np.exp(-3 * (d - w) ** 2 / r**2)))
    assert one(spark, numpy(d, r, w, s))[0] == pytest.approx(2 * g)


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a[0]", "foo(a)", "z", "'s'", "True", "lambda: a", "a if a else a", "exp(a, x=1)", "a < a < a", "~a", "exp(*a)", "exp()", "a +"])
def test_unsafe_expressions(text):
    with pytest.raises(ValueError):
        expressions.compile_expr(text, ["a"])


def test_expressions(spark):
    cols = {"a": F.lit(-7.0), "n": F.lit(None).cast("double")}
    run = lambda t: one(spark, expressions.compile_expr(t, cols)(cols))[0]
    assert run("a % 3") == 2 and run("a // 2") == -4 and run("a / 0") == -math.inf and run("0 * (a / 0)") is None
    assert run("maximum(a, n)") is None and run("where(n < 1, 1, 2)") == 2 and run("clip(a, -2, 2)") == -2
    assert run("(a < 0) * 3 + (n < 0)") == 3 and run("log(0)") == -math.inf and run("sqrt(a)") is None and run("where(a < 0 and a > -9, 1, 0)") == 1
    assert expressions.compile_expr("a + 1", cols).expr == "a + 1"


def test_variograms():
    v = geostat.parse_variogram("2 Sph(100) + 1.5 Gau(50) + 1e+1 Exp(30)")
    assert [(p["type"], p["par1"], p["par2"]) for p in v] == [("Sph", 2, 100), ("Gau", 1.5, 50), ("Exp", 10, 30)]
    for bad in ("", "2", "2 Sph", "Sph(3)", "2 Sph(3) x", "nan Sph(3)"):
        with pytest.raises(ValueError):
            geostat.parse_variogram(bad)
    assert geostat.semivariance(v, np.array([0.0]))[0] == 0 and geostat.semivariance(v, np.array([1e9]))[0] == pytest.approx(13.5)
    with pytest.raises(ValueError, match="model"):
        geostat.semivariance(geostat.parse_variogram("1 Nug(0)"), np.array([1.0]))


def test_inversion_and_draws():
    m, c = geostat.invert(np.eye(2), np.eye(2), np.array([4.0, 8.0]), np.array([0, 1]))
    assert np.allclose(m, [2, 4]) and np.allclose(c, np.eye(2) / 2)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    cm, g = a @ a.T + np.eye(5), np.eye(5)[[0, 3]]
    m2, c2 = geostat.least_squares_inversion(g, cm, np.eye(2), 0, np.array([1.0, -1.0]))
    m1, c1 = geostat.least_squares_inversion(g, cm, np.eye(2), 0, np.array([1.0, -1.0]), type=1)
    m, c = geostat.invert(cm, np.eye(2), np.array([1.0, -1.0]), np.array([0, 3]))
    assert np.allclose(m2, m) and np.allclose(c2, c) and m1.shape == m2.shape and c1.shape == c2.shape
    d = geostat.cholesky_draws(np.array([[2.0, 0.5], [0.5, 1.0]]), 100_000, rng, m0=np.array([3.0, 4.0]))
    assert np.allclose(np.cov(d), [[2, 0.5], [0.5, 1]], atol=0.05) and np.allclose(d.mean(axis=1), [3, 4], atol=0.05)
    with pytest.raises(NotImplementedError):
        geostat.distances(np.zeros((1, 2)), transform=np.eye(2))
    assert np.allclose(geostat.distances(np.array([3.0, 4.0])), [[3], [4]])


def test_interpolation():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-10, 10, (2, 40))
    lin = geostat.interpolate(x, y, 2 * x - 3 * y + 1, 8, 9)
    gx, gy = np.meshgrid(*[np.linspace(-8, 8, 9)] * 2)
    ok = np.isfinite(lin)
    assert ok.mean() > 0.5 and np.allclose(lin[ok], (2 * gx - 3 * gy + 1)[ok])
    assert np.isnan(geostat.interpolate(x[:3], y[:3], x[:3], 8, 9)).all()
    assert np.isfinite(geostat.interpolate(x, y, x, 8, 9, "nearest")).all()
