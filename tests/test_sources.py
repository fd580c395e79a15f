"""JPEG against the JVM's own codec, EXIF from a file built by hand, styles as XML."""

import struct

import numpy as np
import pytest

from lumigrid.sources import images, jpeg, styles


def picture(h=37, w=53):
    y, x = np.indices((h, w))
    return np.stack([x / (w - 1), y / (h - 1), 0.5 + 0.4 * np.sin(x / 7) * np.cos(y / 9)], axis=-1)


def java(spark):
    return spark.sparkContext._jvm


def by_java(spark, data: bytes) -> np.ndarray:
    j = java(spark)
    image = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(bytearray(data)))
    h, w = image.getHeight(), image.getWidth()
    rgb = np.array([[image.getRGB(x, y) for x in range(w)] for y in range(h)]).astype(np.int64) & 0xFFFFFF
    return np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=-1) / 255


@pytest.mark.parametrize("quality", [100, 90, 40, 5])
def test_jpeg_is_read_alike_by_another_decoder(spark, quality):
    a = picture()
    data = jpeg.encode(a, quality)
    ours, theirs = jpeg.decode(data), by_java(spark, data)
    assert ours.shape == a.shape and np.abs(ours - theirs).max() <= 4 / 255
    assert np.abs(ours - a).mean() < {100: 0.004, 90: 0.012, 40: 0.03, 5: 0.12}[quality]


def test_jpeg_by_another_encoder(spark):
    """Subsampled colours, in the JVM's own coding."""
    j = java(spark)
    a = picture(40, 64)
    image = j.java.awt.image.BufferedImage(64, 40, 1)
    for y in range(40):
        for x in range(64):
            r, g, b = (int(v * 255 + 0.5) for v in a[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = j.java.io.ByteArrayOutputStream()
    assert j.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    assert np.abs(jpeg.decode(data) - by_java(spark, data)).mean() < 0.01  # theirs smooths between colours
    assert np.abs(jpeg.decode(data) - a).mean() < 0.03


def test_odd_jpegs():
    grey = jpeg.decode(jpeg.encode(np.full((3, 5, 1), 0.5), 95))
    assert grey.shape == (3, 5, 1) and np.abs(grey - 0.5).max() < 0.01
    noise = np.random.default_rng(1).random((24, 24, 3))
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)) - noise).mean() < 0.02
    data = jpeg.encode(picture())
    for bad in (b"", b"\xff\xd8", data[:40], data.replace(b"\xff\xc0", b"\xff\xc2"), b"PNG"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
    with pytest.raises(ValueError):
        jpeg.encode(picture(), 0)


def exif(order: str) -> bytes:
    """An APP1 segment with a main, a picture and a GPS directory."""
    heap, base = b"", 0

    def entry(tag, kind, count, value: bytes):
        nonlocal heap
        if len(value) <= 4:
            return struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        at = 1000 + len(heap)
        heap += value
        return struct.pack(order + "HHII", tag, kind, count, at)

    short, long_ = lambda v: struct.pack(order + "H", v), lambda v: struct.pack(order + "I", v)
    ratio = lambda *v: struct.pack(order + "I" * len(v), *v)
    directory = lambda *e: struct.pack(order + "H", len(e)) + b"".join(e) + b"\0\0\0\0"
    sub = directory(entry(0x829A, 5, 1, ratio(1, 200)), entry(0x829D, 5, 1, ratio(28, 10)), entry(0x8827, 3, 1, short(400)), entry(0x9003, 2, 20, b"2021:05:06 07:08:09\0"), entry(0x920A, 5, 1, ratio(50, 1)))
    gps = directory(entry(1, 2, 2, b"S\0"), entry(2, 5, 3, ratio(10, 1, 30, 1, 36, 1)), entry(3, 2, 2, b"E\0"), entry(4, 5, 3, ratio(20, 1, 0, 1, 0, 1)), entry(6, 5, 1, ratio(1234, 10)))
    main = directory(entry(0x010F, 2, 5, b"Nova\0"), entry(0x0110, 2, 8, b"Orion 1\0"), entry(0x0112, 3, 1, short(6)), entry(0x8769, 4, 1, long_(300)), entry(0x8825, 4, 1, long_(600)))
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + main
    tiff = (tiff.ljust(300, b"\0") + sub).ljust(600, b"\0") + gps
    return b"Exif\0\0" + tiff.ljust(1000, b"\0") + heap


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    body = exif(order)
    data = jpeg.encode(picture())
    data = data[:2] + struct.pack(">HH", 0xFFE1, len(body) + 2) + body + data[2:]
    said = jpeg.read_exif(data)
    assert (said["maker"], said["model"], said["orientation"], said["iso"], said["datetime_original"]) == ("Nova", "Orion 1", 6, 400, "2021:05:06 07:08:09")
    assert (said["exposure"], said["aperture"], said["focal_length"], said["alt"]) == (0.005, 2.8, 50.0, 123.4)
    assert said["lat"] == pytest.approx(-10.51) and said["lon"] == 20.0
    assert jpeg.read_exif(body[6:])["model"] == "Orion 1" and jpeg.read_exif(jpeg.encode(picture())) == {} == jpeg.read_exif(b"II*\0")
    rows = spark.createDataFrame([("a.jpg", bytearray(data)), ("b.jpg", bytearray(data[:60])), ("c.txt", bytearray(b"x"))], "path string, content binary")
    got = {r.path: r for r in images.read_exif(rows).collect()}
    assert got["a.jpg"].model == "Orion 1" and got["a.jpg"].iso == 400 and got["b.jpg"].error and got["c.txt"].maker is None
    assert images.read_exif(rows.limit(0)).count() == 0


def test_styles(spark):
    items = [{"operation": "exposure", "params": bytes(range(20)), "modversion": 6}, {"operation": "sharpen", "enabled": False, "multi_name": "soft & low"}]
    text = styles.write_style("warm <1>", items, "a style")
    back = styles.read_style(text)
    assert (back["name"], back["description"]) == ("warm <1>", "a style")
    assert [(i["num"], i["operation"], i["enabled"], i["params"], i["modversion"], i["multi_name"]) for i in back["items"]] == [(0, "exposure", True, bytes(range(20)), 6, ""), (1, "sharpen", False, b"", 0, "soft & low")]
    for bad in ("", "<a/>", "<a><info/><style/></a>", "<a><info><name>n</name></info><style><plugin/></style></a>"):
        with pytest.raises(ValueError):
            styles.read_style(bad)
    rows = spark.createDataFrame([("x", bytearray(text.encode())), ("y", bytearray(b"<"))], "path string, content binary")
    got = styles.style_items(rows).collect()
    assert sorted((r.path, r.operation, r.error is None) for r in got if r.path == "x") == [("x", "exposure", True), ("x", "sharpen", True)] and [r.error is None for r in got if r.path == "y"] == [False]


def test_batch(spark, tmp_path, capsys):
    """A folder through an edit to files: two sizes, a folder below, a broken file."""
    from lumigrid import cli
    from lumigrid.plans.pipeline import Pipeline

    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "a.pfm").write_bytes(images.write_pfm(picture(20, 30) * 0.4))
    (source / "sub/b.jpg").write_bytes(jpeg.encode(picture(16, 24)))
    (source / "bad.png").write_bytes(b"x")
    (tmp_path / "edit.json").write_text(Pipeline.create(defaults=("exposure",)).set_param("exposure", "exposure", 1.0).to_json())
    assert cli.main([str(source), str(target), "--history", str(tmp_path / "edit.json"), "--extension", "png", "--width", "15"]) == 1
    assert "2 written, 1 not readable" in capsys.readouterr().out
    a, b = images.read_png((target / "a.png").read_bytes()), images.read_png((target / "sub/b.png").read_bytes())
    assert a.shape == (10, 15, 3) and b.shape == (10, 15, 3)
    from lumigrid.operators import kernels

    want = kernels.resample(picture(20, 30) * 0.8, scale=0.5)
    want = np.where(want <= 0.0031308, 12.92 * want, 1.055 * np.maximum(want, 0.0031308) ** (1 / 2.4) - 0.055)
    assert np.abs(a - np.clip(want, 0, 1)).max() < 2 / 255
