import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import color
from lumigrid.operators import kernels, tiles
from lumigrid.plans.pipeline import ORDERS, Pipeline, PipelineError
from lumigrid.sources import images, sidecars

H, W, TILE = 40, 52, 16


def ramp():
    y, x = np.indices((H, W))
    return ((x * 7 + y * 13 + (x * y) % 11) % 64) / 63.0


def frame(spark, a):
    return spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(H) for x in range(W)], "img_id long, y int, x int, c0 double")


def array(px, h=H, w=W):
    out = np.full((h, w), np.nan)
    for r in px.collect():
        out[r.y, r.x] = r.c0
    return out


@pytest.mark.parametrize("name", ["gaussian", "median", "sharpen", "guided", "atrous", "diffuse", "green_equilibrate", "clahe", "toneequal"])
def test_tiles_equal_the_whole_image(spark, name):
    a = ramp()
    t = tiles.from_pixels(frame(spark, a), H, W, tile=TILE)
    got = array(tiles.to_pixels(tiles.run_kernel(t, name, TILE), TILE))
    assert np.allclose(got, kernels.KERNELS[name].run(a), atol=1e-9)


def test_tiles_round_trip_and_regions(spark):
    a = ramp()
    t = tiles.from_pixels(frame(spark, a), H, W, tile=TILE)
    assert np.array_equal(array(tiles.to_pixels(t, TILE)), a)
    assert {(r.ty, r.tx) for r in tiles.region(t, 0, 10, 20, 30, TILE).collect()} == {(0, 1)}


def colours(spark, a):
    return frame(spark, a).withColumn("c1", F.col("c0") * 0.5).withColumn("c2", 1 - F.col("c0"))


def stack(px, h, w):
    out = np.full((h, w, 3), np.nan)
    for r in px.collect():
        out[r.y, r.x] = r.c0, r.c1, r.c2
    return out


def test_three_channels_at_once(spark):
    a = np.stack([ramp(), ramp() * 0.5, 1 - ramp()], axis=-1)
    t = tiles.from_pixels(colours(spark, ramp()), H, W, ["c0", "c1", "c2"], TILE)
    for name in ("median", "guided", "color_smoothing"):
        got = stack(tiles.to_pixels(tiles.run_kernel(t, name, TILE), TILE, ["c0", "c1", "c2"]), H, W)
        assert np.allclose(got, kernels.KERNELS[name].run(a), atol=1e-9), name
    mosaic = tiles.from_pixels(frame(spark, ramp()), H, W, tile=TILE)
    got = stack(tiles.to_pixels(tiles.run_kernel(mosaic, "demosaic", TILE), TILE, ["c0", "c1", "c2"]), H, W)
    assert np.allclose(got, kernels.demosaic(ramp()), atol=1e-9)


@pytest.mark.parametrize(("name", "params"), [("resample", {"scale": 0.3}), ("resample", {"scale": 1.7}), ("rotate", {"degrees": 33.0}), ("lens", {"k1": 0.2}), ("liquify", {}), ("spot", {"dx": -9.0}), ("homography", {"matrix": ((0.9, 0.1, 3), (0.0, 1.1, -2), (0.001, 0, 1))})])
def test_warped_tiles_equal_the_whole_image(spark, name, params):
    a = ramp()
    t = tiles.from_pixels(frame(spark, a), H, W, tile=TILE)
    whole = kernels.WARPS[name](a, **params)
    got = array(tiles.to_pixels(tiles.run_warp(t, name, TILE, **params), TILE), *whole.shape)
    assert np.allclose(got, whole, atol=1e-9)


def test_halo_wider_than_a_tile_is_refused(spark):
    with pytest.raises(ValueError):
        tiles.run_kernel(tiles.from_pixels(frame(spark, ramp()), H, W, tile=8), "shadhi", 8)


def test_kernels_keep_a_flat_image():
    flat = np.full((24, 24), 0.4)
    for name in ("gaussian", "box_mean", "median", "sharpen", "bilateral", "guided", "nlmeans", "diffuse", "defringe"):
        assert np.allclose(kernels.KERNELS[name].run(flat), flat, atol=1e-9), name
    assert np.allclose(kernels.demosaic(flat), 0.4)
    assert np.allclose(kernels.resample(flat, scale=0.5), 0.4)


def test_distance_and_dither():
    mask = np.zeros((9, 9))
    mask[2:7, 2:7] = 1
    assert kernels.distance_transform(mask)[4, 4] == 3
    out = kernels.floyd_steinberg(np.full((16, 16), 0.25))
    assert set(np.unique(out)) <= {0.0, 1.0} and abs(out.mean() - 0.25) < 0.05


@pytest.mark.parametrize(("extension", "near", "options"), [("ppm", 1 / 500, {}), ("ppm", 1e-4, {"bits": 16}), ("pfm", 1e-6, {}), ("png", 1 / 500, {}), ("png", 1e-4, {"bits": 16}), ("qoi", 1 / 500, {}), ("hdr", 0.02, {}), ("tif", 1e-4, {}), ("tif", 1e-6, {"bits": 32})])
def test_image_files_round_trip(extension, near, options):
    y, x = np.indices((13, 17))
    a = np.stack([x / 16, y / 12, (x * y % 7) / 6], axis=-1).astype(float)
    data = images.WRITERS[extension](a, **options)
    assert np.abs(images.decode("a." + extension, data) - a).max() < near


def test_image_folder(spark, tmp_path):
    a = np.random.default_rng(1).random((5, 6, 3))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.pfm").write_bytes(images.write_pfm(a))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.nef").write_bytes(b"raw")
    rows = {os.path.basename(r.path): r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert np.allclose(np.array(rows["a.pfm"].pixels).reshape(5, 6, 3), a, atol=1e-6) and rows["b.png"].error
    films, found = images.import_folder(spark, str(tmp_path))
    assert films.count() == 2 and {r.filename: r.kind for r in found.collect()} == {"a.pfm": "hdr", "b.png": "ldr", "c.nef": "raw"}
    with pytest.raises(images.Unsupported):
        images.decode("x.cr3", b"")


def test_sidecars(spark):
    data = bytes(range(40))
    assert sidecars.decode_params(sidecars.encode_params(data)) == data == sidecars.decode_params(sidecars.encode_params(data, True))
    with pytest.raises(ValueError):
        sidecars.decode_params("abc")
    entries = sidecars.read_xmp(sidecars.write_xmp([{"operation": "exposure", "params": data}, {"operation": "sharpen", "enabled": False}]))
    assert [(e["num"], e["operation"], e["enabled"], e["params"]) for e in entries] == [(0, "exposure", True, data), (1, "sharpen", False, b"")]
    good = json.dumps({"version": "1.0", "modules": {"exposure": {"enabled": True, "version": 6, "params": {"exposure": 1.5}}}})
    docs = spark.createDataFrame([(1, good), (2, "{"), (3, '{"modules":{}}'), (4, '{"version":"2.0"}'), (5, None)], "id int, d string")
    assert [(r.id, r.operation, r.params) for r in sidecars.history_entries(docs, "id", "d").collect()] == [(1, "exposure", {"exposure": 1.5})]
    gpx = b'<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>3</ele><time>2020-01-01T00:00:01Z</time></trkpt><trkpt lat="x" lon="1"/></trkseg></trk></gpx>'
    assert [tuple(r) for r in sidecars.gpx_points(spark.createDataFrame([("p", bytearray(gpx))], "path string, content binary")).collect()] == [("p", 1577836801000000, 1.5, 2.5, 3.0)]


def test_pipeline_documents():
    p = Pipeline.create()
    p.set_param("exposure", "exposure", 1.0).enable("velvia").set_param("velvia", "strength", 0.3)
    q = Pipeline.from_json(p.to_json())
    assert q.to_json() == p.to_json() and q.get_param("exposure", "exposure") == 1.0 and q.is_enabled("velvia")
    for bad in ("{", "{}", '{"version": "2.1"}', '{"version": null}'):
        with pytest.raises(PipelineError):
            Pipeline.from_json(bad)
    assert Pipeline.from_json('{"version": "1.7", "modules": {"nope": {}}}').stages
    for name, param, value in (("exposure", "exposure", 99), ("nope", "x", 1)):
        with pytest.raises(PipelineError):
            p.set_param(name, param, value)
    assert all(len(set(o)) == len(o) for o in ORDERS.values())
    p.move_before("sharpen", "velvia")
    assert [s.name for s in p.stages].index("sharpen") < [s.name for s in p.stages].index("velvia")
    with pytest.raises(PipelineError):
        p.move_before("sharpen", "demosaic")


def test_orders():
    """Where the five orders differ."""
    place = {k: {n: i for i, n in enumerate(v)} for k, v in ORDERS.items()}
    assert {len(v) for v in ORDERS.values()} == {92} and len({frozenset(v) for v in ORDERS.values()}) == 1 and len({tuple(v) for v in ORDERS.values()}) == 5
    for k, p in place.items():
        assert (p["finalscale"] < p["colorout"]) == k.startswith("v5.0")
        assert (p["colorin"] == p["demosaic"] + 1) == k.endswith("JPEG")
        assert (p["agx"] < p["sigmoid"]) == (k == "v3.0 JPEG")
        assert (p["exposure"] < p["lens"]) == (k == "legacy")
        assert ORDERS[k][0] == "rawprepare" and ORDERS[k][-1] == "gamma"
    assert ORDERS["v5.0 RAW"][place["v5.0 RAW"]["finalscale"] :][:3] == ["finalscale", "colorout", "clahe"]


def test_pipeline_renders(spark):
    a = ramp()
    df = colours(spark, a)
    p = Pipeline.create(defaults=("exposure",)).set_param("exposure", "exposure", 1.0)
    assert np.allclose(array(p.render(df, H, W)), a * 2)
    p.enable("soften")
    soft = kernels.soften(np.stack([a, a * 0.5, 1 - a], axis=-1) * 2)[..., 0]
    whole = array(p.render(df, H, W, tile=TILE))
    assert np.allclose(whole, soft, atol=1e-9)
    part = array(p.render(df, H, W, region=(20, 10, 12, 8), tile=TILE), 8, 12)
    assert np.allclose(part, whole[10:18, 20:32], atol=1e-9)
    for scale in (0.25, 0.7, 1.5):
        small = kernels.resample(soft, scale=scale)
        assert small.shape == (int(H * scale), int(W * scale))
        assert np.allclose(array(p.render(df, H, W, scale=scale, tile=TILE), *small.shape), small, atol=1e-9)
    window = array(p.render(df, H, W, scale=0.7, region=(5, 6, 20, 10), tile=TILE), 7, 14)
    assert np.allclose(window, kernels.resample(soft, scale=0.7)[6:13, 5:19], atol=1e-9)
    for bad in ({"scale": 0}, {"scale": 0.001}, {"region": (0, 0, 0, 4)}):
        with pytest.raises(PipelineError):
            p.render(df, H, W, **bad)


def test_lab_kernels_work_on_lightness(spark):
    """Sharpening in a pipeline goes through Lab and leaves a and b."""
    a = np.stack([ramp(), ramp() * 0.5 + 0.2, 0.9 - ramp() * 0.6], axis=-1)
    df = frame(spark, a[..., 0]).withColumn("c1", F.col("c0") * 0.5 + 0.2).withColumn("c2", 0.9 - F.col("c0") * 0.6)
    m = np.array(color.SRGB_TO_XYZ_D50)
    f = lambda t: np.where(t > color.EPSILON, np.cbrt(t), (color.KAPPA * t + 16) / 116)
    x, y, z = np.moveaxis(f((a @ m.T) / np.array(color.D50)), -1, 0)
    lab = np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)
    lab = np.concatenate([kernels.sharpen(lab[..., 0])[..., None], lab[..., 1:]], axis=-1)
    fy = (lab[..., 0] + 16) / 116
    t = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    want = np.where(t > color.EPSILON ** (1 / 3), t**3, (116 * t - 16) / color.KAPPA) * np.array(color.D50) @ np.array(color.XYZ_D50_TO_SRGB).T
    got = stack(Pipeline.create(defaults=("sharpen",)).render(df, H, W, tile=TILE), H, W)
    assert np.allclose(got, want, atol=1e-6)


def test_every_stage_renders_or_raises(spark):
    """No enabled stage is passed over: it changes the plan, or says that it can't."""
    from lumigrid.plans import pipeline

    df = colours(spark, ramp())
    for name in ORDERS["v5.0 RAW"]:
        p = Pipeline.create(defaults=(name,))
        if pipeline._kind(name) is None:
            with pytest.raises(PipelineError):
                p.render(df, H, W)
        else:
            assert p.render(df, H, W, tile=TILE).columns == ["img_id", "y", "x", "c0", "c1", "c2"]
    assert {n for n in ORDERS["v5.0 RAW"] if pipeline._kind(n) is None} <= {"rasterfile", "cacorrect", "cacorrectrgb", "overlay", "blurs", "colorequal", "colortransfer", "colormapping", "colorreconstruct", "watermark"}


def test_raw_pipeline(spark):
    """A mosaic through the default stages, against numpy."""
    a = ramp()
    p = Pipeline.create().set_param("exposure", "exposure", 1.0)
    for k, v in (("left", 2), ("top", 4), ("right", 1), ("bottom", 3)):
        p.set_param("rawprepare", k, v)
    got = stack(p.render(frame(spark, a), H, W, tile=TILE), H - 7, W - 3)
    want = np.clip(kernels.demosaic(a[4 : H - 3, 2 : W - 1]) * 2, 0.0031308, None)
    want = 1.055 * want ** (1 / 2.4) - 0.055
    assert np.allclose(np.maximum(got, 12.92 * 0.0031308), want, atol=2e-4)
    with pytest.raises(PipelineError):
        Pipeline.create(defaults=("velvia",)).render(frame(spark, a), H, W)


def test_a_chain_of_point_operators_is_one_stage(spark):
    p = Pipeline.create(defaults=("exposure", "velvia", "vibrance", "splittoning"))
    df = frame(spark, ramp()).withColumn("c1", F.col("c0")).withColumn("c2", F.col("c0"))
    assert "Exchange" not in p.render(df, H, W)._jdf.queryExecution().executedPlan().toString()


def test_composite_broadcasts_no_pixels(spark):
    """Pixels made from few suppliers look small, but are not."""
    from lumigrid.queries.raster_queries import composite_overlay
    from tests.conftest import DATA

    plan = composite_overlay(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_soften_agrees_with_sql(spark, duck):
    from lumigrid.queries.raster_queries import ORACLE_SQL, QUERIES
    from tests.conftest import DATA

    ours = {(r.img_id, r.y, r.x): r.c0 for r in QUERIES["kernel_soften"](spark, DATA).collect()}
    theirs = {r[:3]: r[3] for r in duck.sql(ORACLE_SQL["kernel_soften"]).fetchall()}
    assert ours.keys() == theirs.keys() and all(abs(ours[k] - theirs[k]) < 2e-6 for k in theirs)
