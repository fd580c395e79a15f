"""Queries for tiles, kernels, warps and renders, over synthetic images whose number follows the data.

The SQL is written apart from the kernels: stencils as joins with shifted pixels, one axis after the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels, tiles
from ..plans.pipeline import Pipeline
from . import pixel_sql

H, W, TILE = 24, 32, 16
_V = "CAST((x * 7 + y * 13 + img_id * 29 + (x * y) % 11) % 64 AS DOUBLE) / 63"
QUERIES, ORACLE_SQL = {}, {}


def images(spark, folder):
    """One image per supplier: dense pixels by rule."""
    ids = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("img_id"))
    px = ids.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("y")).select("img_id", "y", F.explode(F.sequence(F.lit(0), F.lit(W - 1))).alias("x"))
    return px.withColumn("c0", F.expr(_V))


_SQL = f"(SELECT img_id, y, x, {_V} AS c0 FROM (SELECT CAST(s_suppkey AS BIGINT) AS img_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM supplier, range({H}) a(y), range({W}) b(x))) p"
_PIXELS = f"px AS MATERIALIZED (SELECT img_id, y, x, c0 AS v FROM {_SQL})"


def _kernel(name):
    def run(spark, folder):
        px = images(spark, folder)
        if kernels.KERNELS[name].space == "LAB":  # lightness
            px = px.withColumn("c0", F.col("c0") * 100)
        t = tiles.from_pixels(px, H, W, tile=TILE)
        if name == "demosaic":
            return tiles.to_pixels(tiles.run_kernel(t, name, TILE), TILE, ["c0", "c1", "c2"]).selectExpr("img_id", "y", "x", "round(c0, 6) + 0.0 AS c0", "round(c1, 6) + 0.0 AS c1", "round(c2, 6) + 0.0 AS c2")
        return tiles.to_pixels(tiles.run_kernel(t, name, TILE), TILE).selectExpr("img_id", "y", "x", "round(c0, 6) + 0.0 AS c0")

    return run


for _n in kernels.KERNELS:
    if _n != "color_smoothing":  # works on three channels
        QUERIES[f"kernel_{_n}"] = _kernel(_n)


def _axis(source: str, axis: str, weights: str, name: str, value: str = "v") -> str:
    """A table: ``source`` with ``value`` summed along an axis with weights (d, w), edges repeated."""
    most = {"y": H - 1, "x": W - 1}[axis]
    other = "x" if axis == "y" else "y"
    return f"{name} AS MATERIALIZED (SELECT p.img_id, p.y, p.x, sum(k.w * q.{value}) AS v FROM {source} p, {weights} k, {source} q WHERE q.img_id = p.img_id AND q.{other} = p.{other} AND q.{axis} = least(greatest(p.{axis} + k.d, 0), {most}) GROUP BY p.img_id, p.y, p.x)"


def _bell(sigma: float, radius: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT d, exp(-0.5 * pow(d / {sigma}, 2)) / (SELECT sum(exp(-0.5 * pow(e / {sigma}, 2))) FROM range(-{radius}, {radius + 1}) t(e)) AS w FROM range(-{radius}, {radius + 1}) s(d))"


def _even(radius: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT d, 1.0 / {2 * radius + 1} AS w FROM range(-{radius}, {radius + 1}) s(d))"


def _blurred(weights: str, formula: str, source: str = "v", more: str = "") -> str:
    """SQL of a formula over a pixel's value ``v`` and its blurred surroundings ``b``; ``source`` is what gets blurred."""
    return (
        f"WITH {_PIXELS}, src AS MATERIALIZED (SELECT img_id, y, x, {source} AS v FROM px), {weights}, {_axis('src', 'y', 'weights', 'down')}, {_axis('down', 'x', 'weights', 'across')} "
        f"SELECT p.img_id, p.y, p.x, round({formula.replace('$v', 'p.v').replace('$b', 'q.v')}, 6) + 0.0 AS c0 FROM px p JOIN across q ON q.img_id = p.img_id AND q.y = p.y AND q.x = p.x{more}"
    )


def _shifted(formula: str, places: dict[str, tuple[int, int]]) -> str:
    """SQL of a formula over named neighbours (dy, dx), edges repeated."""
    joins = "".join(f" JOIN px {n} ON {n}.img_id = p.img_id AND {n}.y = least(greatest(p.y + {dy}, 0), {H - 1}) AND {n}.x = least(greatest(p.x + {dx}, 0), {W - 1})" for n, (dy, dx) in places.items())
    return f"WITH {_PIXELS} SELECT p.img_id, p.y, p.x, round({formula}, 6) + 0.0 AS c0 FROM px p{joins}"


_AROUND = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
_CLIP = "greatest(0.0, least(1.0, {}))".format
for _n, _f in (("box_min", "min"), ("box_max", "max"), ("median", "median")):
    _r = 1 if _n == "median" else 3
    ORACLE_SQL[f"kernel_{_n}"] = f"WITH {_PIXELS} SELECT p.img_id, p.y, p.x, round({_f}(q.v), 6) + 0.0 AS c0 FROM px p, range(-{_r}, {_r + 1}) a(dy), range(-{_r}, {_r + 1}) b(dx), px q WHERE q.img_id = p.img_id AND q.y = least(greatest(p.y + dy, 0), {H - 1}) AND q.x = least(greatest(p.x + dx, 0), {W - 1}) GROUP BY p.img_id, p.y, p.x"
ORACLE_SQL |= {
    "kernel_gaussian": _blurred(_bell(2.0, 6, "weights"), "$b"),
    "kernel_box_mean": _blurred(_even(3, "weights"), "$b"),
    "kernel_lowpass": _blurred(_bell(3.0, 9, "weights"), _CLIP("($b - 0.5) * 1.0 + 0.5")),
    "kernel_bilat": _blurred(_bell(4.0, 12, "weights"), "1.5 * $v - 0.5 * $b"),
    "kernel_shadhi": _blurred(_bell(4.0, 12, "weights"), _CLIP("$v + $v * (1.0 - $v) * 0.5 * (" + _CLIP("1.0 - 2.0 * $b") + " - " + _CLIP("2.0 * $b - 1.0") + ")")),
    "kernel_defringe": _blurred(_bell(1.5, 4, "weights"), "CASE WHEN abs($v - $b) > 0.1 THEN $b ELSE $v END"),
    "kernel_scharr": _shifted("sqrt(pow(47.0 / 255 * (ne.v - nw.v + se.v - sw.v) + 162.0 / 255 * (e.v - w.v), 2) + pow(47.0 / 255 * (sw.v - nw.v + se.v - ne.v) + 162.0 / 255 * (s.v - n.v), 2))", _AROUND),
    "kernel_hotpixels": _shifted(
        "CASE WHEN p.v > 0.05 AND CAST(n2.v < p.v * 0.75 AS INT) + CAST(s2.v < p.v * 0.75 AS INT) + CAST(w2.v < p.v * 0.75 AS INT) + CAST(e2.v < p.v * 0.75 AS INT) >= 3 THEN greatest(n2.v, s2.v, w2.v, e2.v) ELSE p.v END",
        {"n2": (-2, 0), "s2": (2, 0), "w2": (0, -2), "e2": (0, 2)},
    ),
}


def _boxed(radius: int, value: str, formula: str) -> str:
    """SQL of a formula over a pixel's value v and what eight box means make of ``value``; at an edge a mean is over what is there."""
    tables = [f"b0 AS (SELECT img_id, y, x, v AS own, {value} AS v FROM px)"]
    for i in range(8):
        tables.append(f"a{i} AS MATERIALIZED (SELECT img_id, y, x, own, avg(v) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM b{i})")
        tables.append(f"b{i + 1} AS MATERIALIZED (SELECT img_id, y, x, own, avg(v) OVER (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM a{i})")
    return f"WITH {_PIXELS}, {', '.join(tables)} SELECT img_id, y, x, round({formula.replace('$v', 'own').replace('$b', 'v')}, 6) + 0.0 AS c0 FROM b8"


_GLOW = "CASE WHEN 100 * v * pow(2.0, 26.0 / 100) > 90 THEN 100 * v * pow(2.0, 26.0 / 100) ELSE 0.0 END"
_WHOLE = f"p.y BETWEEN 2 AND {H - 3} AND p.x BETWEEN 2 AND {W - 3}"
ORACLE_SQL |= {
    "kernel_sharpen": _blurred(_bell(0.8, 2, "weights"), f"100 * $v + CASE WHEN {_WHOLE} AND 100 * $v - $b > 0.5 THEN 0.5 * (100 * $v - $b - 0.5) WHEN {_WHOLE} AND $b - 100 * $v > 0.5 THEN -0.5 * ($b - 100 * $v - 0.5) ELSE 0.0 END", "100 * v"),
    "kernel_highpass": _boxed(2, "100.0 - greatest(0.0, least(100.0, 100 * v))", "greatest(0.0, least(100.0, ($b + 100 * $v - 100.0) * (50.0 / 100 * 7.5 * 0.5) + 50.0))"),
    "kernel_soften": _boxed(1, _CLIP("v * pow(2.0, 0.33)"), "$v * 0.5 + $b * 0.5"),
    "kernel_bloom": _boxed(2, _GLOW, "100.0 - (100.0 - 100 * $v) * (100.0 - $b) / 100.0"),
}
_M1, _M2 = "((nw.v + ne.v + sw.v + se.v) / 4.0)", "((n2.v + s2.v + w2.v + e2.v) / 4.0)"
_C1 = "((abs(nw.v - ne.v) + abs(nw.v - sw.v) + abs(nw.v - se.v) + abs(ne.v - sw.v) + abs(sw.v - se.v) + abs(ne.v - se.v)) / 6.0)"
_C2 = "((abs(n2.v - s2.v) + abs(n2.v - w2.v) + abs(n2.v - e2.v) + abs(s2.v - w2.v) + abs(w2.v - e2.v) + abs(s2.v - e2.v)) / 6.0)"
ORACLE_SQL["kernel_green_equilibrate"] = _shifted(
    f"CASE WHEN p.y % 2 = 1 AND p.x % 2 = 0 AND p.y BETWEEN 2 AND {H - 3} AND p.x BETWEEN 2 AND {W - 3} AND {_M1} > 0 AND {_M2} > 0 AND {_M1} < 2.0 * {_M2} AND p.v < 0.95 AND {_C1} < 0.01 AND {_C2} < 0.01 THEN greatest(0.0, p.v * {_M1} / {_M2}) ELSE p.v END",
    {"nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1), "n2": (-2, 0), "s2": (2, 0), "w2": (0, -2), "e2": (0, 2)},
)


def _warp(name):
    def run(spark, folder):
        t = tiles.from_pixels(images(spark, folder), H, W, tile=TILE)
        run_ = tiles.run_warp if name in kernels.WARPS else tiles.run_whole
        return tiles.to_pixels(run_(t, name, TILE), TILE).selectExpr("img_id", "y", "x", "round(c0, 6) + 0.0 AS c0")

    return run


for _n in (*kernels.WARPS, *kernels.WHOLE):
    QUERIES[f"geometry_{_n}"] = _warp(_n)


def _sampled(sy: str, sx: str, value: str = "s") -> str:
    """SQL of bilinear sampling at (sy, sx), edges repeated; ``value`` is a formula over the sample s."""
    return f"""WITH {_PIXELS}, spot AS (SELECT img_id, y, x, v, {sy} AS sy, {sx} AS sx FROM px), cell AS (SELECT *, CAST(floor(sy) AS INT) AS y0, CAST(floor(sx) AS INT) AS x0 FROM spot)
    SELECT img_id, y, x, round({value}, 6) + 0.0 AS c0 FROM (SELECT p.img_id, p.y, p.x, sum((CASE dy WHEN 0 THEN 1.0 - (sy - y0) ELSE sy - y0 END) * (CASE dx WHEN 0 THEN 1.0 - (sx - x0) ELSE sx - x0 END) * q.v) AS s
    FROM cell p, range(0, 2) a(dy), range(0, 2) b(dx), px q WHERE q.img_id = p.img_id AND q.y = least(greatest(y0 + dy, 0), {H - 1}) AND q.x = least(greatest(x0 + dx, 0), {W - 1}) GROUP BY p.img_id, p.y, p.x)"""


_DY, _DX = f"(y - {(H - 1) / 2})", f"(x - {(W - 1) / 2})"
_R2 = f"(pow({_DX} / {W / 2}, 2) + pow({_DY} / {W / 2}, 2))"
_PULL = "pow(greatest(0.0, least(1.0, 1.0 - (pow(x - 16.0, 2) + pow(y - 12.0, 2)) / 64.0)), 2)"
ORACLE_SQL |= {
    "geometry_rotate": _sampled(f"{(H - 1) / 2} - sin(radians(10.0)) * {_DX} + cos(radians(10.0)) * {_DY}", f"{(W - 1) / 2} + cos(radians(10.0)) * {_DX} + sin(radians(10.0)) * {_DY}"),
    "geometry_homography": f"WITH {_PIXELS} SELECT img_id, y, x, round(v, 6) + 0.0 AS c0 FROM px",
    "geometry_lens": _sampled(f"{_DY} * (1.0 + 0.05 * {_R2}) + {(H - 1) / 2}", f"{_DX} * (1.0 + 0.05 * {_R2}) + {(W - 1) / 2}", f"s * (1.0 + 0.1 * {_R2})"),
    "geometry_liquify": _sampled("CAST(y AS DOUBLE)", f"x - 3.0 * {_PULL}"),
    "geometry_spot": f"WITH {_PIXELS} SELECT p.img_id, p.y, p.x, round(q.v, 6) + 0.0 AS c0 FROM px p JOIN px q ON q.img_id = p.img_id AND q.y = p.y AND q.x = CASE WHEN pow(p.x - 16, 2) + pow(p.y - 12, 2) <= 64 THEN least(p.x + 4, {W - 1}) ELSE p.x END",
    "geometry_distance_transform": f"WITH {_PIXELS}, down AS MATERIALIZED (SELECT p.img_id, p.y, p.x, min(CASE WHEN q.v <= 0.5 THEN pow(q.y - p.y, 2) END) AS d FROM px p JOIN px q ON q.img_id = p.img_id AND q.x = p.x GROUP BY p.img_id, p.y, p.x) SELECT p.img_id, p.y, p.x, round(sqrt(min(pow(q.x - p.x, 2) + q.d)), 6) + 0.0 AS c0 FROM down p JOIN down q ON q.img_id = p.img_id AND q.y = p.y GROUP BY p.img_id, p.y, p.x",
}


def geometry_crop(spark, folder):
    return tiles.crop(images(spark, folder), 5, 30, 8, 50)


def geometry_flip(spark, folder):
    return tiles.flip(images(spark, folder), H, W, vertical=True, transpose=True).select("img_id", "y", "x", "c0")


def geometry_borders(spark, folder):
    return tiles.borders(images(spark, folder), H, W, 3, 0.5)


def composite_overlay(spark, folder):
    below = images(spark, folder)
    above = below.where("(x + y) % 3 = 0").selectExpr("img_id", "y", "x", "1 - c0 AS c0", "cast(x % 5 as double) / 4 AS alpha")
    return tiles.composite(below, above, 0.5).selectExpr("img_id", "y", "x", "round(c0, 6) AS c0")


def region_of_interest(spark, folder):
    t = tiles.region(tiles.from_pixels(images(spark, folder), H, W, tile=TILE), 10, 20, 10, 20, TILE, 3)
    return t.select("img_id", "ty", "tx", F.size("data").alias("n"))


QUERIES |= {f.__name__: f for f in (geometry_crop, geometry_flip, geometry_borders, composite_overlay, region_of_interest)}
ORACLE_SQL |= {
    "geometry_crop": f"SELECT img_id, y - 5 AS y, x - 8 AS x, c0 FROM {_SQL} WHERE y BETWEEN 5 AND 29 AND x BETWEEN 8 AND 49",
    "geometry_flip": f"SELECT img_id, x AS y, {H - 1} - y AS x, c0 FROM {_SQL}",
    "geometry_borders": f"SELECT img_id, y + 3 AS y, x + 3 AS x, c0 FROM {_SQL} UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(y AS INT), CAST(x AS INT), 0.5 FROM supplier, range({H + 6}) a(y), range({W + 6}) b(x) WHERE NOT (y BETWEEN 3 AND {H + 2} AND x BETWEEN 3 AND {W + 2})",
    "composite_overlay": f"SELECT img_id, y, x, round(CASE WHEN (x + y) % 3 = 0 AND x % 5 > 0 THEN c0 * (1 - CAST(x % 5 AS DOUBLE) / 4 * 0.5) + (1 - c0) * (CAST(x % 5 AS DOUBLE) / 4 * 0.5) ELSE c0 END, 6) AS c0 FROM {_SQL}",
    "region_of_interest": "SELECT CAST(s_suppkey AS BIGINT) AS img_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, CAST(CASE ty WHEN 0 THEN 256 ELSE 128 END AS INT) AS n FROM supplier, range(0, 2) a(ty), range(0, 2) b(tx)",
}


# --- renders of whole pipelines


def _colours(spark, folder):
    return images(spark, folder).withColumn("c1", F.expr("1 - c0")).withColumn("c2", F.expr("c0 * c0"))


def _rounded(df):
    return df.selectExpr("img_id", "y", "x", *(f"round({c}, 6) + 0.0 AS {c}" for c in ("c0", "c1", "c2")))


def render_default(spark, folder):
    """The stages that are on by default, on a raw mosaic."""
    p = Pipeline.create().set_param("exposure", "exposure", 0.5).set_param("rawprepare", "raw_white_point", 1)
    return _rounded(p.render(images(spark, folder), H, W, tile=TILE))


def render_scaled(spark, folder):
    """Half the size of colours with more light: floor(size * scale)."""
    return _rounded(Pipeline.create(defaults=("exposure",)).set_param("exposure", "exposure", 1.0).render(_colours(spark, folder), H, W, scale=0.3, tile=TILE))


def render_region(spark, folder):
    p = Pipeline.create(defaults=("exposure", "colorin", "colorout", "flip")).set_param("exposure", "exposure", 0.5).set_param("flip", "orientation", 2)
    return _rounded(p.render(_colours(spark, folder), H, W, region=(20, 10, 12, 8), tile=TILE))


def render_geometry(spark, folder):
    """Crop, flip, frame, and 8-bit values."""
    p = Pipeline.create(defaults=("crop", "flip", "borders", "colorin", "colorout", "gamma")).set_param("flip", "orientation", 5).set_param("borders", "size", 2)
    for k, v in (("cx", 0.25), ("cy", 0.125), ("cw", 0.75), ("ch", 0.875)):
        p.set_param("crop", k, v)
    return _rounded(p.render(_colours(spark, folder), H, W, tile=TILE))


QUERIES |= {f.__name__: f for f in (render_default, render_scaled, render_region, render_geometry)}


def _mirrored(axis: str, shift, most: int) -> str:
    """An index past an edge, reflected there."""
    return f"{most} - abs({most} - abs({axis} + {shift}))"


def _near(names: dict[str, tuple[int, int]]) -> str:
    return "".join(f" JOIN px {n} ON {n}.img_id = p.img_id AND {n}.y = {_mirrored('p.y', dy, H - 1)} AND {n}.x = {_mirrored('p.x', dx, W - 1)}" for n, (dy, dx) in names.items())


# Which way is smoother is often a tie; the order of these sums keeps it one.
_GH, _GV = "(abs(w1.v - e1.v) + abs(2 * p.v - w2.v - e2.v))", "(abs(n1.v - s1.v) + abs(2 * p.v - n2.v - s2.v))"
_ACROSS, _DOWN = "((e1.v + w1.v) / 2 + (2 * p.v - e2.v - w2.v) / 4)", "((s1.v + n1.v) / 2 + (2 * p.v - s2.v - n2.v) / 4)"
_GREEN = f"green AS MATERIALIZED (SELECT p.img_id, p.y, p.x, p.v, CASE WHEN (p.y + p.x) % 2 = 1 THEN p.v WHEN {_GH} < {_GV} THEN {_ACROSS} WHEN {_GV} < {_GH} THEN {_DOWN} ELSE ({_ACROSS} + {_DOWN}) / 2 END AS g FROM px p{_near({'e1': (0, 1), 'w1': (0, -1), 'n1': (-1, 0), 's1': (1, 0), 'e2': (0, 2), 'w2': (0, -2), 'n2': (-2, 0), 's2': (2, 0)})})"
#: Red stands at even places of both axes, blue at odd ones; the weight of a neighbour halves for each axis it is off on.
_WEIGHT = "(1.0 / (1 + abs(dy)) / (1 + abs(dx)))"
_RGB = f"""rgb AS MATERIALIZED (SELECT p.img_id, p.y, p.x, greatest(p.g + sum(CASE WHEN q.y % 2 = 0 AND q.x % 2 = 0 THEN {_WEIGHT} * (q.v - q.g) ELSE 0 END) / sum(CASE WHEN q.y % 2 = 0 AND q.x % 2 = 0 THEN {_WEIGHT} ELSE 0 END), 0.0) AS r, greatest(p.g, 0.0) AS g,
    greatest(p.g + sum(CASE WHEN q.y % 2 = 1 AND q.x % 2 = 1 THEN {_WEIGHT} * (q.v - q.g) ELSE 0 END) / sum(CASE WHEN q.y % 2 = 1 AND q.x % 2 = 1 THEN {_WEIGHT} ELSE 0 END), 0.0) AS b
    FROM green p, range(-1, 2) i(dy), range(-1, 2) j(dx), green q WHERE q.img_id = p.img_id AND q.y = {_mirrored('p.y', 'dy', H - 1)} AND q.x = {_mirrored('p.x', 'dx', W - 1)} GROUP BY p.img_id, p.y, p.x, p.g)"""
_DEMOSAICED = f"WITH {_PIXELS}, {_GREEN}, {_RGB} "
_CODED = pixel_sql.rows(*pixel_sql.TO_XYZ, names="e0 e1 e2", out="xx yy zz") + "\n" + pixel_sql.rows(*pixel_sql.TO_SRGB, names="xx yy zz", out="t0 t1 t2") + "\n" + pixel_sql.each("CASE WHEN $ <= 0.0031308 THEN 12.92 * $ ELSE 1.055 * pow(greatest($, 0.0031308), 1.0 / 2.4) - 0.055 END", "t0 t1 t2")
_THREE = [f"round(o{i}, 6) + 0.0 AS c{i}" for i in range(3)]
_COLOURS = f"(SELECT img_id, y, x, c0 AS r, 1.0 - c0 AS g, c0 * c0 AS b FROM {_SQL})"
_BYTES = [f"floor(255 * greatest(0.0, least(1.0, o{i})) + 0.5) AS c{i}" for i in range(3)]
_SINC = "(CASE WHEN {0} = 0 THEN 1.0 WHEN abs({0}) >= 3 THEN 0.0 ELSE sin(pi() * {0}) / (pi() * {0}) * sin(pi() * {0} / 3) / (pi() * {0} / 3) END)".format
_FRAME_H, _FRAME_W = W - W // 4 + 4, H // 2 + 4
ORACLE_SQL |= {
    "kernel_demosaic": _DEMOSAICED + "SELECT img_id, y, x, round(r, 6) + 0.0 AS c0, round(g, 6) + 0.0 AS c1, round(b, 6) + 0.0 AS c2 FROM rgb",
    "render_default": _DEMOSAICED + pixel_sql.select(pixel_sql.each("$ * sqrt(2.0)", out="e0 e1 e2") + "\n" + _CODED, "rgb", ["img_id", "y", "x"], _THREE),
    "render_region": pixel_sql.select(pixel_sql.each("$ * sqrt(2.0)", out="e0 e1 e2") + "\n" + _CODED, f"(SELECT img_id, CAST(y - 10 AS INT) AS y, CAST({W - 1} - x - 20 AS INT) AS x, r, g, b FROM {_COLOURS} c WHERE y BETWEEN 10 AND 17 AND {W - 1} - x BETWEEN 20 AND 31)", ["img_id", "y", "x"], _THREE),
    "render_geometry": pixel_sql.select(pixel_sql.each("$", out="e0 e1 e2") + "\n" + _CODED, f"(SELECT img_id, CAST(x - {W // 8} + 2 AS INT) AS y, CAST({H - 1} - y - {H // 4} + 2 AS INT) AS x, r, g, b FROM {_COLOURS} c WHERE x BETWEEN {W // 8} AND {W - W // 8 - 1} AND {H - 1} - y BETWEEN {H // 4} AND {H - H // 4 - 1})", ["img_id", "y", "x"], _BYTES)
    + f" UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(y AS INT), CAST(x AS INT), 255.0, 255.0, 255.0 FROM supplier, range({_FRAME_H}) a(y), range({_FRAME_W}) b(x) WHERE NOT (y BETWEEN 2 AND {_FRAME_H - 3} AND x BETWEEN 2 AND {_FRAME_W - 3})",
    # a channel at a time, under the key 3 * image + channel
    "render_scaled": f"WITH px AS MATERIALIZED (SELECT 3 * img_id + c AS img_id, y, x, 2.0 * CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM {_COLOURS} t, range(0, 3) k(c)), {_bell(0.5 / 0.3, 5, 'weights')}, {_axis('px', 'y', 'weights', 'down')}, {_axis('down', 'x', 'weights', 'across')}, "
    f"spot AS MATERIALIZED (SELECT y, x, (y + 0.5) / 0.3 - 0.5 AS sy, (x + 0.5) / 0.3 - 0.5 AS sx FROM range({int(H * 0.3)}) a(y), range({int(W * 0.3)}) b(x)), "
    f"taps AS MATERIALIZED (SELECT y, x, CAST(least(greatest(floor(sy) + dy, 0), {H - 1}) AS INT) AS qy, CAST(least(greatest(floor(sx) + dx, 0), {W - 1}) AS INT) AS qx, {_SINC('(sy - floor(sy) - dy)')} * {_SINC('(sx - floor(sx) - dx)')} AS w FROM spot, range(-2, 4) i(dy), range(-2, 4) j(dx)), "
    "done AS (SELECT q.img_id // 3 AS img_id, q.img_id % 3 AS c, t.y, t.x, sum(t.w * q.v) / sum(t.w) AS v FROM taps t JOIN across q ON q.y = t.qy AND q.x = t.qx GROUP BY q.img_id, t.y, t.x) "
    "SELECT img_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(f"round(max(CASE WHEN c = {i} THEN v END), 6) + 0.0 AS c{i}" for i in range(3)) + " FROM done GROUP BY img_id, y, x",
}
