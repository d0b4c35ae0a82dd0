"""Every registered query against its SQL on the smallest tables, and operators that SQL cannot express."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoflow.functions import geostat
from lithoflow.operators import clusters, kriging, nearest, rangesill, themes
from lithoflow.plans import catalog

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "region", "orders", "part", "lineitem", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    flat = lambda rows: sorted(str([round(float(v), 6) if isinstance(v, float) else v for v in x]) for x in rows)
    assert flat([tuple(x[c] for c in cols) for x in df.collect()]) == flat([tuple(x[k] for k in at) for x in r.fetchall()])


def test_nearest_on_uneven_axes(spark):
    """The scatter plan against the definition, on axes without even spacing."""
    rng = np.random.default_rng(4)
    gx, gy = np.sort(rng.choice(200, 9, replace=False)) * 1.0, np.sort(rng.choice(200, 7, replace=False)) * 1.0
    pts = [(k, float(x), float(y), float(k % 5)) for k, (x, y) in enumerate(rng.integers(-10, 210, (60, 2)))]
    pts.append((60, float(gx[3]), float(gy[2]), 1.0))
    df = spark.createDataFrame(pts, "pid long, x double, y double, v double")
    for radius in (1, 3):
        got = {(r.iy, r.ix): (round(r.d, 9), r.n_ties, r.v) for r in nearest.windowed_nearest(df, gx, gy, radius, {"v": "max"}).collect()}
        want = {}
        for i in range(len(gy)):
            for j in range(len(gx)):
                xlo, xhi, ylo, yhi = gx[max(0, j - radius)], gx[min(8, j + radius)], gy[max(0, i - radius)], gy[min(6, i + radius)]
                near = [(((gx[j] - x) ** 2 + (gy[i] - y) ** 2) ** 0.5, v) for _, x, y, v in pts if xlo < x < xhi and ylo < y < yhi]
                if near:
                    d = min(near)[0]
                    t = [v for a, v in near if a == d]
                    want[(i, j)] = (round(d, 9), len(t), max(t))
        assert got == want
    with pytest.raises(ValueError, match="reducer"):
        nearest.windowed_nearest(df, gx, gy, 1, {"v": "median"})


def test_spec_documents(tmp_path):
    s = themes.load_spec(catalog._DRONE)
    themes.dump_spec_yaml(s, tmp_path / "s.yaml")
    assert themes.dump_spec(themes.load_spec_yaml(tmp_path / "s.yaml")) == themes.dump_spec(s)
    assert [themes.parse_layers(v) for v in ("all", "L01-L13", "l14-END", "L05", [0, 2])] == ["all", (0, 12), (13, None), (4, 4), [0, 2]]
    assert [themes.format_layers(v) for v in ("all", (0, 12), (13, None), (4, 4), [0, 2])] == ["all", "L01-L13", "L14-end", "L05", [0, 2]]
    for change in ({"cert_fun": "x"}, {"combine": "sum"}, {"attributes": {}}, {"var0": "__import__('os')"}):
        with pytest.raises(ValueError):
            themes.load_spec(catalog._DRONE | change)
    with pytest.raises(ValueError, match="exactly once"):
        themes.range_rows([themes.RangeGroup((0, 1), [1, 2])], 3)
    with pytest.raises(ValueError):
        themes.dump_spec(themes.fewtem(2))
    with pytest.raises(ValueError, match="unknown"):
        themes.resolve_theme_spec("nope", 2)


def test_buffer_ramp():
    m = np.zeros((25, 25), bool)
    m[7:18, 7:18] = True
    w = kriging.buffer_weights(m)[12] * 7
    assert np.allclose(w[3:14], [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7])
    with pytest.raises(ValueError):
        kriging.buffer_weights(np.zeros((3, 3), bool))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity):
    m = np.random.default_rng(connectivity).random((30, 33)) < 0.55
    rows = [(1, int(y), int(x)) for y, x in zip(*np.nonzero(m))]
    got = kriging.connected_components(spark.createDataFrame(rows, "z int, iy int, ix int"), ["z"], connectivity, tile=7).collect()
    want = kriging._label(m, connectivity)
    assert len(got) == len(rows) and all(want[r.iy, r.ix] == r.component for r in got)


def test_kriging(spark):
    """One window against the dense formula, and draws that agree with the posterior."""
    rng = np.random.default_rng(0)
    n = 8
    obs = rng.normal(0, 2, (n, n))
    cells = [(0, y, x) for y in range(n) for x in range(n)]
    c = spark.createDataFrame(cells, "layer int, iy int, ix int")
    g = spark.createDataFrame([(*k, float(obs[k[1], k[2]]), 0.5) for k in cells], "layer int, iy int, ix int, dobs double, unc double")
    cond = c.where("(iy * 3 + ix) % 5 = 0")
    w = kriging.build_windows(c.withColumn("label", F.lit(1)), c, cond, spark.createDataFrame([(0, 1, 300.0)], "layer int, label int, range double"), c.withColumn("variance", F.lit(4.0)), n, n)
    out = kriging.simulate_layers(g, w, 400, seed=1).orderBy("iy", "ix").collect()
    yy, xx = np.divmod(np.arange(n * n), n)
    data = (yy * 3 + xx) % 5 == 0
    cm, cd, d = geostat.kriging_system(xx * 100.0, yy * 100.0, obs.ravel(), np.full(n * n, 0.5), data, 4.0, 300.0, 0.5)
    m, cov = geostat.invert(cm, cd, d, np.flatnonzero(data))
    assert np.allclose([r["mean"] for r in out], m) and np.allclose([r.post_std for r in out], np.sqrt(np.diag(cov)))
    assert np.allclose(np.std([r.reals for r in out], axis=1), np.sqrt(np.diag(cov)), rtol=0.2, atol=0.02)
    with pytest.raises(ValueError, match="active"):
        kriging.build_windows(c.withColumn("label", F.lit(1)), c.where("ix > 2"), cond, None, None, n, n)


def test_zones_and_estimates(spark):
    f = geostat.synthetic_field(21, 21, 100, 500, 4, seed=2)
    s = spark.createDataFrame([(y, x, float(f[y, x])) for y in range(21) for x in range(21)], "iy int, ix int, value double")
    est = rangesill.estimate_surface(s, s.where("(iy + 2 * ix) % 3 = 0"), 21, 21, rangesill.VariogramEstimator(7), minigrid_size=9)
    rows = est.collect()
    assert len(rows) == 441 and sum(r.range is not None for r in rows) > 400 and all(abs(r.residual + r.lf_mean - f[r.iy, r.ix]) < 1e-9 for r in rows)
    zones, stats = clusters.build_zones(est, 21, 21, max_cluster_size=60)
    sizes = zones.groupBy("label").count().collect()
    assert zones.count() == 441 and len(sizes) == stats.count()


def test_kmeans_and_som():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (20, 2))])
    lab = clusters.kmeans(x, 2)
    assert len(set(lab[:30])) == len(set(lab[30:])) == 1 and lab[0] != lab[-1]
    with pytest.raises(ValueError):
        clusters.kmeans(x[:1], 2)
    w = clusters.train_som(x[rng.permutation(50)], x.min(0), x.max(0), (2, 2))
    near = ((x[:, None] - w) ** 2).sum(2).argmin(1)
    assert not set(near[:30]) & set(near[30:])


def test_network_learns(spark, tmp_path):
    settings = rangesill.TrainingSettings(interp_grid_size=9, minigrid_size=11, range_bounds=(100, 900), n_scatter_points=60)
    data = rangesill.generate_training_data(spark, 120, settings)
    rangesill.save_training_data(data, str(tmp_path / "d"), settings)
    data, back = rangesill.load_training_data(spark, str(tmp_path / "d"))
    assert back == settings
    net = rangesill.train_estimator(data, 9, epochs=60, lr=5e-3)
    rows = data.collect()
    pred = [math_log(net.predict(np.array(r.patch).reshape(9, 9))[0]) for r in rows]
    assert np.corrcoef(pred, [r.log_range for r in rows])[0, 1] > 0.6
    net.save(str(tmp_path / "w.npz"))
    again = rangesill.NetworkEstimator.load(str(tmp_path / "w.npz"))
    assert again.predict(np.array(rows[0].patch).reshape(9, 9)) == net.predict(np.array(rows[0].patch).reshape(9, 9))


def math_log(v):
    return float(np.log(v))


def test_network_gradient():
    rng = np.random.default_rng(0)
    for arch in ("conv", "dense"):
        net = rangesill.NetworkEstimator(9, 4, arch)
        x, y = rng.normal(size=(3, 9, 9)), rng.normal(size=3)
        pred, keep = net.forward(x)
        g = net.gradient(x, keep, 2 * (pred - y))
        for k in net.w:
            at = tuple(rng.integers(s) for s in net.w[k].shape)
            old, e = net.w[k][at], 1e-6
            net.w[k][at] = old + e
            up = ((net.forward(x)[0] - y) ** 2).sum()
            net.w[k][at] = old - e
            down = ((net.forward(x)[0] - y) ** 2).sum()
            net.w[k][at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[k][at], rel=1e-3, abs=1e-6)


def test_streaming(spark, tmp_path):
    from lithoflow.streaming.precision import running_combination

    rows = spark.createDataFrame([(0, 0, 0, 4.0), (0, 0, 0, 4.0), (0, 1, 0, None), (1, 1, 0, float("inf"))], "iy int, ix int, layer int, variance double")
    rows.write.parquet(str(tmp_path / "in"))
    q = running_combination(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.iy, r.ix): (r.variance, r.n) for r in spark.table("running").collect()} == {(0, 0): (2.0, 2), (1, 1): (float("inf"), 1)}
