"""Queries for pixel operators, colour spaces, blends and masks.

Line items play pixels. The SQL comes from ``pixel_sql``, written apart from the plans.
"""

from __future__ import annotations

from ..functions import color, curves
from ..operators import blend, pixels, statistics
from ..plans.layers import Plan
from . import pixel_sql

# x, y in a 100 x 80 frame, and three channels in the space's usual range
PIXELS = {
    "RGB": "CAST(l_discount * 9.7 + 0.013 AS DOUBLE) AS c0, CAST(l_tax * 11.3 + 0.021 AS DOUBLE) AS c1, CAST(l_quantity / 51.3 AS DOUBLE) AS c2",
    "LAB": "CAST(l_quantity * 1.937 + 0.3 AS DOUBLE) AS c0, CAST((l_discount - 0.047) * 1003.1 AS DOUBLE) AS c1, CAST((l_tax - 0.039) * 907.7 AS DOUBLE) AS c2",
}
PIXELS["RAW"] = PIXELS["RGB"]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_PLACE = ["CAST(l_orderkey % 100 AS DOUBLE) AS x", "CAST(l_partkey % 80 AS DOUBLE) AS y"]
_ROUNDED = ("c0", "c1", "c2", "m", "d", "delta_e")
#: What blends read: below a0-a2, above b0-b2, the mask m.
_ABOVE = [f"CAST({e} AS DOUBLE) AS {n}" for n, e in (("a0", "l_discount * 9.7 + 0.013"), ("a1", "l_tax * 11.3 + 0.021"), ("a2", "l_quantity / 51.3"), ("b0", "CAST(l_partkey % 97 AS DOUBLE) * 0.01023"), ("b1", "CAST(l_orderkey % 89 AS DOUBLE) * 0.01107"), ("b2", "CAST(l_suppkey % 10 AS DOUBLE) * 0.0937 + 0.017"), ("m", "CAST(l_linenumber % 5 AS DOUBLE) * 0.23317394 + 0.01131797"))]

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, plan: Plan, space: str, sql: str | None, columns=("c0", "c1", "c2"), extra=()) -> None:
    """A query that runs a plan over the pixels; ``sql`` defines o0, o1, o2 (or what stands for ``columns``) on its own."""

    def run(spark, folder):
        df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*_KEYS, *_PLACE, *PIXELS[space].split(", "), *extra)
        return plan.apply(df).selectExpr(*_KEYS, *(f"round({c}, 6) + 0.0 AS {c}" if c in _ROUNDED else c for c in columns))

    QUERIES[name] = run
    if sql is None:
        return
    channels = PIXELS[space].replace("AS c0", "AS l" if space == "LAB" else "AS r").replace("AS c1", "AS a" if space == "LAB" else "AS g").replace("AS c2", "AS b")
    source = f"(SELECT {', '.join([*_KEYS, *_PLACE, channels, *extra])} FROM lineitem)"
    theirs = {"c0": "o0", "c1": "o1", "c2": "o2", "m": "m_", "d": "m_"}
    out = [f"round({theirs.get(c, c)}, 6) + 0.0 AS {c}" if c in _ROUNDED else c for c in columns]
    ORACLE_SQL[name] = pixel_sql.select(sql, source, _KEYS, out)


#: Parameters of the registered operators, where not their defaults.
PARAMETERS = {
    "exposure": {"black": 0.002, "ev": 0.7}, "highlights_clip": {"clip": 0.9}, "velvia": {"strength": 40.0, "bias": 0.7}, "vibrance": {"amount": 50.0},
    "levels": {"grey": 0.4}, "rawprepare": {"black": (0.01, 0.02, 0.03, 0.04), "white": 0.95},
}
for _n, _op in pixels.POINT_OPS.items():
    _columns = ("c0", "c1", "c2", "mark") if "overexposed" in _n else ("c0", "c1", "c2")
    _add(f"pixel_{_n}", _op.make(Plan(), **PARAMETERS.get(_n, {})), _op.space, pixel_sql.POINT.get(_n), _columns)
_add("pixel_graduatednd_light", pixels.graduatednd(Plan(), density=-0.8, hardness=60.0, rotation=70.0, offset=40.0, tint=(0.2, 0.1, 0.0)), "RGB", pixel_sql.POINT["graduatednd_light"])
_add("pixel_rgbcurve_norm", pixels.rgbcurve(Plan(), preserve="luminance"), "RGB", pixel_sql.POINT["rgbcurve_norm"])
_add("pixel_rgbcurve_cubic", pixels.rgbcurve(Plan(), ((0.0, 0.0), (0.5, 0.7), (1.0, 1.0)), kind=curves.CUBIC), "RGB", pixel_sql.POINT["rgbcurve_cubic"])
_add("pixel_basecurve_catmull_rom", pixels.basecurve(Plan(), ((0.0, 0.0), (0.4, 0.3), (1.0, 1.0)), kind=curves.CATMULL_ROM), "RGB", pixel_sql.POINT["basecurve_catmull_rom"])
_add("pixel_colorbalance_lgg", pixels.colorbalance(Plan(), mode="lift_gamma_gain"), "LAB", pixel_sql.POINT["colorbalance_lgg"])
for _n, _make in color.SPACES.items():
    _add(f"color_{_n}", _make(), "LAB" if _n.startswith(("lab", "to_polar", "from_polar")) else "RGB", pixel_sql.COLOR.get(_n))
_add("color_delta_e", color.delta_e_76(Plan(), ("50", "10", "-5")), "LAB", pixel_sql.DELTA_E, ("delta_e",))

for _mode in (*blend.SCENE, "red", "green", "blue"):
    _add(f"blend_scene_{_mode}", blend.scene(Plan(), _mode, 0.3), "RGB", pixel_sql.SCENE[_mode], extra=_ABOVE)
_add("blend_scene_reverse", blend.scene(Plan(), "divide", 0.3, reverse=True), "RGB", pixel_sql.SCENE["reverse"], extra=_ABOVE)
for _mode in (*blend.DISPLAY, *blend.HSL_MODES, *blend.HSV_MODES, *blend.CHANNELS):
    _add(f"blend_display_{_mode}", blend.display(Plan(), _mode), "RGB", pixel_sql.DISPLAY[_mode], extra=_ABOVE)
for _mode in blend.LAB_MODES:
    _add(f"blend_{_mode}", blend.lab(Plan(), _mode), "LAB", pixel_sql.LAB[_mode], extra=_ABOVE)
for _mode in blend.DISPLAY:
    _add(f"blend_raw_{_mode}", blend.display(Plan(), _mode), "RAW", pixel_sql.RAW[_mode], ("c0",), extra=_ABOVE)
_add("blend_raw_normal_unbounded", blend.display(Plan(), "normal", bounded=False), "RAW", pixel_sql.RAW["normal_unbounded"], ("c0",), extra=_ABOVE)
_RANGES = {"ranges": {"c0": (0.1, 0.3, 0.6, 0.9), "c2": (0.0, 0.2, 0.5, 0.7)}, "inverted": frozenset(["c2"])}
_MASKS = {
    "uniform": {}, "drawn": {"drawn": "shape"}, "drawn_inverse": {"drawn": "shape", "inverse": True}, "ranges": _RANGES, "both": {"drawn": "shape"} | _RANGES, "both_inverse": {"drawn": "shape", "inverse": True} | _RANGES,
    "inclusive": {"drawn": "shape", "inclusive": True} | _RANGES, "inclusive_inverse": {"drawn": "shape", "inclusive": True, "inverse": True} | _RANGES, "raster": {"raster": "earlier"}, "raster_inverse": {"raster": "earlier", "inverse": True},
}
for _mode, _options in _MASKS.items():
    _start = blend.circle(50, 40, 20, 10, "shape").let(earlier="(x % 10) / 10")
    _add(f"mask_mode_{_mode}", blend.mask(_start, 0.913702, **_options), "RGB", pixel_sql.MASK_MODES[_mode], ("m",))
_add("mask_circle", blend.circle(50, 40, 20, 10), "RGB", pixel_sql.MASK["circle"], ("m",))
_add("mask_ellipse", blend.ellipse(50, 40, 30, 15, 25, 0.4), "RGB", pixel_sql.MASK["ellipse"], ("m",))
_add("mask_gradient", blend.gradient(50, 40, 30, 12), "RGB", pixel_sql.MASK["gradient"], ("m",))
_add("mask_parametric", blend.parametric(Plan(), {"c0": (0.1, 0.3, 0.6, 0.9), "c2": (0.0, 0.2, 0.5, 0.7)}, frozenset(["c2"])), "RGB", pixel_sql.MASK["parametric"], ("m",))
for _how in blend.COMBINE:
    _both = blend.circle(50, 40, 20, 10, "m1").then(blend.gradient(50, 40, 30, 12, "d"))
    _add(f"mask_{_how}", blend.combine(_both, _how, "m1", 0.8, _how == "difference"), "RGB", pixel_sql.MASK[_how], ("d",))

#: A chain as an edit would have it: exposure, mix, saturation and the display's curve, masked and blended.
_CHAIN = color.linear_to_srgb(pixels.sigmoid(pixels.velvia(pixels.channelmixer(pixels.exposure(Plan(), 0.001, 0.5)), 40.0, 0.7)))
_add("pixel_chain", _CHAIN, "RGB", pixel_sql.CHAIN)


def histogram_rgb(spark, folder):
    from pyspark.sql import functions as F

    from ..operators.statistics import histogram

    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*PIXELS["RGB"].split(", "))
    return histogram(df, ["c0", "c1", "c2"], 256).select("channel", "bin", F.col("n"))


def picker(spark, folder):
    from ..operators.statistics import picker as stats

    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("CAST(l_orderkey % 100 AS DOUBLE) AS x", "CAST(l_partkey % 80 AS DOUBLE) AS y", *PIXELS["RGB"].split(", "))
    return stats(df, ["c0", "c1", "c2"], (10, 20, 60, 50)).selectExpr("channel", "round(mean, 6) AS mean", "low", "high", "n")


def half_size(spark, folder):
    from ..operators.statistics import block_average

    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("CAST(l_orderkey % 100 AS INT) AS x", "CAST(l_partkey % 80 AS INT) AS y", *PIXELS["RGB"].split(", "))
    return block_average(df, 4, ["c0", "c1", "c2"]).selectExpr("x", "y", "round(c0, 9) AS c0", "round(c1, 9) AS c1", "round(c2, 9) AS c2")


QUERIES |= {"raster_histogram": histogram_rgb, "raster_picker": picker, "raster_half_size": half_size}
_SRC = f"(SELECT CAST(l_orderkey % 100 AS INT) AS x, CAST(l_partkey % 80 AS INT) AS y, {PIXELS['RGB']} FROM lineitem)"
ORACLE_SQL |= {
    "raster_histogram": " UNION ALL ".join(f"SELECT '{c}' AS channel, CAST(greatest(0, least(255, trunc({c} * 255))) AS INT) AS bin, count(*) AS n FROM {_SRC} GROUP BY 2" for c in ("c0", "c1", "c2")),
    "raster_picker": " UNION ALL ".join(f"SELECT '{c}' AS channel, round(avg({c}), 6) AS mean, min({c}) AS low, max({c}) AS high, count(*) AS n FROM {_SRC} WHERE x >= 10 AND x < 60 AND y >= 20 AND y < 50" for c in ("c0", "c1", "c2")),
    "raster_half_size": f"SELECT CAST(x // 4 AS INT) AS x, CAST(y // 4 AS INT) AS y, round(avg(c0), 9) AS c0, round(avg(c1), 9) AS c1, round(avg(c2), 9) AS c2 FROM {_SRC} GROUP BY x // 4, y // 4",
}


# --- statistics in other spaces, exposures and profiles


def _pixels(spark, folder, plan):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("CAST(l_orderkey % 100 AS DOUBLE) AS x", "CAST(l_partkey % 80 AS DOUBLE) AS y", *PIXELS["RGB"].split(", "))
    return plan.apply(df)


_LCH = color.to_polar(color.rgb_to_lab())


def raster_histogram_lab(spark, folder):
    return statistics.histogram(_pixels(spark, folder, color.rgb_to_lab()), ["c0", "c1", "c2"], 256, ranges=statistics.LAB_RANGES)


def raster_histogram_lch(spark, folder):
    return statistics.histogram(_pixels(spark, folder, _LCH), ["c0", "c1", "c2"], 256, ranges=statistics.LCH_RANGES)


def _picked(plan):
    def run(spark, folder):
        return statistics.picker(_pixels(spark, folder, plan), ["c0", "c1", "c2"], (10, 20, 60, 50)).selectExpr("channel", "round(mean, 6) + 0.0 AS mean", "round(low, 6) + 0.0 AS low", "round(high, 6) + 0.0 AS high", "n")

    return run


def raster_deflicker(spark, folder):
    """Stops that even out a series of images, one for each 40 orders."""
    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_orderkey % 40 AS img_id", *PIXELS["RGB"].split(", "))
    return statistics.deflicker_ev(df, "c2", 70.0, -3.0, ["img_id"]).selectExpr("img_id", "round(ev, 6) + 0.0 AS ev")


def raster_hdr_merge(spark, folder):
    """Brackets of three exposures, merged place by place."""
    shots = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_orderkey % 100 AS x", "l_partkey % 80 AS y", "power(2.0D, l_linenumber % 3) AS exposure", "CAST(l_quantity / 51.3 AS DOUBLE) AS c0")
    return statistics.merge_exposures(shots).selectExpr("x", "y", "round(c0, 6) + 0.0 AS c0")


def noise_profiles(spark, folder):
    """Noise of every image between the profiles around its ISO."""
    profiles = spark.createDataFrame([(100.0, 1.5e-4, 2e-8), (800.0, 9e-4, 5e-7), (3200.0, 4e-3, 6e-6)], "iso double, a double, b double")
    images = spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey AS id", "CAST(50 * (1 + o_orderkey % 100) AS DOUBLE) AS iso")
    return statistics.interpolate_profiles(images, profiles, ["a", "b"]).selectExpr("id", "iso", "round(a, 10) + 0.0 AS a", "round(b, 12) + 0.0 AS b")


_POINTS = ((20.0, 10.0), (80.0, 15.0), (60.0, 70.0), (40.0, 30.0), (15.0, 60.0))


def mask_path(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*_KEYS, *_PLACE)
    return blend.path(_POINTS, 12.0).apply(df).selectExpr(*_KEYS, "round(m, 6) + 0.0 AS m")


def mask_brush(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*_KEYS, *_PLACE)
    return blend.brush(_POINTS, 9.0, 0.4).apply(df).selectExpr(*_KEYS, "round(m, 6) + 0.0 AS m")


QUERIES |= {f.__name__: f for f in (raster_histogram_lab, raster_histogram_lch, raster_deflicker, raster_hdr_merge, noise_profiles, mask_path, mask_brush)}
QUERIES |= {"raster_picker_lab": _picked(color.rgb_to_lab()), "raster_picker_lch": _picked(_LCH), "raster_picker_hsl": _picked(color.rgb_to_hsl())}
_PLACED = f"(SELECT CAST(l_orderkey % 100 AS DOUBLE) AS x, CAST(l_partkey % 80 AS DOUBLE) AS y, {PIXELS['RGB'].replace('AS c0', 'AS r').replace('AS c1', 'AS g').replace('AS c2', 'AS b')} FROM lineitem)"
_IN_LAB = pixel_sql.select(pixel_sql.COLOR["rgb_to_lab"], _PLACED, ["x", "y"], ["o0 AS l", "o1 AS a", "o2 AS b"])
_IN_LCH = pixel_sql.select(pixel_sql.COLOR["to_polar"], f"({_IN_LAB})", ["x", "y"], ["o0", "o1", "o2"])
_IN_LAB = f"SELECT x, y, l AS o0, a AS o1, b AS o2 FROM ({_IN_LAB})"
_IN_HSL = pixel_sql.select(pixel_sql.COLOR["rgb_to_hsl"], _PLACED, ["x", "y"], ["o0", "o1", "o2"])


def _bins(source: str, ranges: tuple[tuple[str, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT 'c{i}' AS channel, CAST(greatest(0, least(255, trunc((o{i} - ({low})) / (({high}) - ({low})) * 255))) AS INT) AS bin, count(*) AS n FROM ({source}) GROUP BY 2" for i, (low, high) in enumerate(ranges))


def _box(source: str) -> str:
    return " UNION ALL ".join(f"SELECT 'c{i}' AS channel, round(avg(o{i}), 6) + 0.0 AS mean, round(min(o{i}), 6) + 0.0 AS low, round(max(o{i}), 6) + 0.0 AS high, count(*) AS n FROM ({source}) WHERE x >= 10 AND x < 60 AND y >= 20 AND y < 50" for i in range(3))


_NEAR = "(VALUES " + ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(_POINTS, [*_POINTS[1:], _POINTS[0]]))) + ") e(i, x0, y0, x1, y1)"
_OFF = "sqrt(pow(x - x0 - greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) * (x1 - x0), 2) + pow(y - y0 - greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) * (y1 - y0), 2))"
_SPOTS = "(SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_orderkey % 100 + 0.0 AS x, l_partkey % 80 + 0.0 AS y FROM lineitem)"
ORACLE_SQL |= {
    "raster_histogram_lab": _bins(_IN_LAB, (("0.0", "100.0"), ("-128.0", "128.0"), ("-128.0", "128.0"))),
    "raster_histogram_lch": _bins(_IN_LCH, (("0.0", "100.0"), ("0.0", "128.0 * sqrt(2.0)"), ("0.0", "1.0"))),
    "raster_picker_lab": _box(_IN_LAB), "raster_picker_lch": _box(_IN_LCH), "raster_picker_hsl": _box(_IN_HSL),
    "raster_deflicker": "WITH v AS (SELECT l_orderkey % 40 AS img_id, greatest(0, least(16383, floor(CAST(l_quantity / 51.3 AS DOUBLE) * 16384))) AS lev FROM lineitem), r AS (SELECT img_id, lev, count(*) OVER (PARTITION BY img_id ORDER BY lev) AS below, count(*) OVER (PARTITION BY img_id) AS n FROM v) SELECT img_id, round(-3.0 - log2(greatest(min(lev), 1) / 16384.0), 6) + 0.0 AS ev FROM r WHERE below >= n * 0.7 GROUP BY img_id",
    "raster_hdr_merge": "WITH s AS (SELECT l_orderkey % 100 AS x, l_partkey % 80 AS y, pow(2.0, l_linenumber % 3) AS e, CAST(l_quantity / 51.3 AS DOUBLE) AS v FROM lineitem), w AS (SELECT *, CASE WHEN v >= 0.98 THEN 0.000001 ELSE greatest(0.000001, 1.0 - pow(2.0 * v - 1.0, 4)) END AS w FROM s) SELECT x, y, round(sum(w * v / e) / sum(w), 6) + 0.0 AS c0 FROM w GROUP BY x, y",
    "noise_profiles": "WITH i AS (SELECT o_orderkey AS id, CAST(50 * (1 + o_orderkey % 100) AS DOUBLE) AS iso FROM orders) SELECT id, iso, round(CASE WHEN iso <= 100 THEN 1.5e-4 WHEN iso <= 800 THEN 1.5e-4 + (iso - 100) / 700 * (9e-4 - 1.5e-4) WHEN iso <= 3200 THEN 9e-4 + (iso - 800) / 2400 * (4e-3 - 9e-4) ELSE 4e-3 END, 10) + 0.0 AS a, round(CASE WHEN iso <= 100 THEN 2e-8 WHEN iso <= 800 THEN 2e-8 + (iso - 100) / 700 * (5e-7 - 2e-8) WHEN iso <= 3200 THEN 5e-7 + (iso - 800) / 2400 * (6e-6 - 5e-7) ELSE 6e-6 END, 12) + 0.0 AS b FROM i",
    "mask_path": f"SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN sum(CASE WHEN (y0 > y) <> (y1 > y) AND x < x0 + (x1 - x0) * (y - y0) / (y1 - y0) THEN 1 ELSE 0 END) % 2 = 1 THEN 1.0 ELSE pow(greatest(0.0, 1.0 - min({_OFF}) / 12.0), 2) END, 6) + 0.0 AS m FROM {_SPOTS} p, {_NEAR} GROUP BY rid, 1, 2, 3",
    "mask_brush": f"SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0.0, least(1.0, (9.0 - min({_OFF})) / (9.0 * 0.6))), 6) + 0.0 AS m FROM {_SPOTS} p, {_NEAR} WHERE i < 4 GROUP BY rid, 1, 2, 3",
}
