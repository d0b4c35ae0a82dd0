import numpy as np
import pytest

from lithoflow.operators.grid import GridMeta, grids_aligned, require_ascending
from lithoflow.sources import bundles, codecs, rasters

META = GridMeta.of({"ncols": 7, "nrows": 5, "cellsize": 100, "xllcorner": 500000, "yllcorner": 6200000, "crs": "EPSG:25832"})


def array(dtype=float):
    z = np.random.default_rng(1).normal(50, 9, (5, 7)).astype(dtype)
    return z


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i2"])
def test_geotiff(compression, dtype):
    z = np.round(array()).astype(dtype).astype(float)
    out, m = codecs.read_geotiff(codecs.write_geotiff(z, META, -9999.0, compression, dtype))
    assert np.array_equal(out, z) and grids_aligned(m, META) and m.crs == "EPSG:25832" and m.nodata == -9999


def test_large_lzw():
    raw = np.random.default_rng(2).integers(0, 5, 60_000).astype(np.uint8).tobytes()
    assert codecs.lzw_decode(codecs.lzw_encode(raw)) == raw
    big = GridMeta.of({"ncols": 333, "nrows": 301, "dx": 25, "xllcorner": 1, "yllcorner": 2})
    z = np.random.default_rng(3).normal(size=(301, 333)).astype("f4")
    assert np.array_equal(codecs.read_geotiff(codecs.write_geotiff(z, big))[0], z)


def test_esri_and_surfer():
    z = array()
    z[1, 2] = np.nan
    for write, read in ((codecs.write_esri, codecs.read_esri), (codecs.write_surfer7, codecs.read_surfer7)):
        out, m = read(write(z, META))
        assert np.array_equal(out, z, equal_nan=True) and grids_aligned(m, META)
    text = b"NCOLS 3\nnrows 2\nXLLCENTER 125\nyllcenter 225\ncellsize 50\nNODATA_value -9999\n1 2 3\n4 5 -9999\n"
    out, m = codecs.read_esri(text)
    assert (m.xllcorner, m.yllcorner) == (100, 200) and np.isnan(out[1, 2])
    for bad in (b"", b"ncols 2\nnrows 1\ncellsize 1\nxllcorner 0\nyllcorner 0\n1\n"):
        with pytest.raises(ValueError):
            codecs.read_esri(bad)
    with pytest.raises(ValueError):
        codecs.read_surfer7(b"nope")


def test_meta():
    assert META.dy == 100 and META.x()[0] == 500050 and META.transform[5] == 6200500
    with pytest.raises(ValueError, match="missing"):
        GridMeta.of({"ncols": 1})
    assert not grids_aligned(META, GridMeta.of(META.as_dict() | {"dx": 50}))
    for bad in ([1, 1], [2, 1], [], [float("nan")]):
        with pytest.raises(ValueError, match="ascending"):
            require_ascending("grid_x", bad)


def test_cli_round_trip(spark, tmp_path):
    """Two stacks through files, command line and back."""
    from lithoflow.__main__ import main

    rng = np.random.default_rng(5)
    stacks = {k: rng.uniform(1, 9, (2, 5, 7)).astype("f4").astype(float) for k in "ab"}
    stacks["a"][:, 0, :] = stacks["b"][:, 0, :] = 100000
    for k, z in stacks.items():
        (tmp_path / k).mkdir()
        for n in range(2):
            (tmp_path / k / f"variance_{n + 1:02d}.tif").write_bytes(codecs.write_geotiff(z[n], META))
    terrain = np.full((5, 7), 60.0)
    (tmp_path / "t.asc").write_bytes(codecs.write_esri(terrain, META))
    for n, depth in enumerate((10.0, 300.0)):
        (tmp_path / f"b{n}.asc").write_bytes(codecs.write_esri(terrain - depth, META))
    args = ["combine", "--theme", str(tmp_path / "a"), "--theme", str(tmp_path / "b"), "--no-prior", "--terrain", str(tmp_path / "t.asc"), "--bottom", str(tmp_path / "b0.asc"), "--bottom", str(tmp_path / "b1.asc"), "--out", str(tmp_path / "out")]
    with pytest.warns(UserWarning, match="7 cell|14 cell"):
        main(args)
    want = 1 / (1 / stacks["a"] + 1 / stacks["b"])
    want = np.maximum(want, np.array([0.1**2, 3.0**2])[:, None, None])
    for n in range(2):
        z, m = codecs.read_geotiff((tmp_path / "out" / f"variance_{n + 1:02d}.tif").read_bytes())
        assert np.allclose(z, want[n], rtol=1e-6) and grids_aligned(m, META)
        s, m = codecs.read_geotiff((tmp_path / "out" / f"std_{n + 1:02d}.tif").read_bytes())
        assert (s[0] == -9999).all() and np.allclose(s[1:], np.sqrt(want[n][1:]), rtol=1e-6)
    with pytest.raises(SystemExit, match="bottoms"):
        main(args[:-4] + args[-2:])
    with pytest.raises(SystemExit):
        main([a.replace(str(tmp_path / "a"), str(tmp_path / "none")) for a in args])
    back, _ = rasters.read_variance_stack(spark, str(tmp_path / "a"))
    assert {(r.iy, r.ix, r.layer): r.variance for r in back.collect()}[(4, 3, 1)] == stacks["a"][1, 0, 3]
    rasters.ascii_to_geotiff(spark, str(tmp_path / "t.asc"), str(tmp_path / "t.tif"), "EPSG:25832", (500100, 500400, 6200100, 6200300))
    z, m = codecs.read_geotiff((tmp_path / "t.tif").read_bytes())
    assert z.shape == (2, 3) and m.xllcorner == 500100 and m.yllcorner == 6200100


CSV = "x,y,doi,depth__L01,depth__L02,depth__L03\n150,110,50,4,9,14\n250,60,,5,11,20\n90,210,33,3,7,12\n"
MANIFEST = {"name": "demo", "spec": "fewtem", "points_csv": "p.csv", "n_layers": 3, "x_column": "x", "y_column": "y", "complexity": "none", "attributes": {"depth": {"per_layer": True, "prefix": "depth__L"}, "doi": {"column": "doi"}}}


def test_bundle(spark, tmp_path):
    import yaml

    (tmp_path / "p.csv").write_text(CSV)

    def load(**change):
        doc = {k: v for k, v in (MANIFEST | change).items() if v is not ...}
        (tmp_path / "m.yaml").write_text(yaml.safe_dump(doc))
        return bundles.load_theme_data(spark, str(tmp_path / "m.yaml"))

    t = load()
    assert [(r.pid, r.x, r.y) for r in t.points.orderBy("pid").collect()] == [(0, 150, 110), (1, 250, 60), (2, 90, 210)]
    rows = {(r.pid, r.layer): (r.depth, r.doi) for r in t.attributes.collect()}
    assert rows[(0, 2)] == (14, 50) and rows[(1, 0)] == (5, None) and len(rows) == 9 and t.spec(2).name == "fewTEM"
    for change, error in (
        ({"name": ...}, ValueError), ({"complexity": ...}, ValueError), ({"n_layers": 2}, ValueError), ({"format_version": 2}, ValueError), ({"x_column": "q"}, ValueError), ({"attributes": {}}, ValueError),
        ({"attributes": {"a": {"column": "zz"}}}, ValueError), ({"points_csv": "none.csv"}, FileNotFoundError), ({"complexity": "external"}, ValueError), ({"attributes": {"a": {"per_layer": True, "prefix": "q"}}}, ValueError),
    ):
        with pytest.raises(error):
            load(**change)


def test_region(spark, tmp_path):
    c = bundles.RegionConfig("r", ["top", "a", "b", "bottom"], surface_dir=str(tmp_path), metadata={"k": 1})
    assert c.modelled_layer_indices == [1, 2] and c.modelled_layer_names == ["a", "b"] and c.surface_path(1).endswith("/a.tif")
    for ext in ("json", "yaml"):
        c.save(spark, str(tmp_path / f"c.{ext}"))
        assert bundles.RegionConfig.from_file(spark, str(tmp_path / f"c.{ext}")) == c
    for bad in ({"layer_names": ["a"]}, {"layer_names": ["a", "a"]}, {"modelled_layers": [9]}, {"typo": 1}):
        with pytest.raises(ValueError):
            bundles.RegionConfig.from_dict({"name": "r", "layer_names": ["a", "b"]} | bad)
    with pytest.raises(KeyError):
        c.surface_path("zzz")
