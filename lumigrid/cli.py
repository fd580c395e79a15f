"""Batch rendering from the command line, as a Spark job: ``python -m lumigrid.cli in_folder out_folder --history edit.json``.

All images below the input folder go through one edit and are written, under their paths, to the output
folder, which driver and executors must share. Files that can't be read are reported, not skipped silently.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import materialize
from .functions import color
from .plans.layers import Plan
from .plans.pipeline import Pipeline
from .sources import images as files

CHANNELS = ["c0", "c1", "c2"]


def pixels_of(decoded: DataFrame) -> DataFrame:
    """(img_id, y, x, c0, c1, c2) of decoded images (path, height, width, channels, pixels); grey ones have their value three times."""
    at = lambda i, c: F.get("pixels", i * F.col("channels") + F.least(F.lit(c), F.col("channels") - 1))
    every = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.struct((i / F.col("width")).cast("int").alias("y"), (i % F.col("width")).cast("int").alias("x"), *(at(i, c).alias(n) for c, n in enumerate(CHANNELS))))
    return decoded.select(F.xxhash64("path").alias("img_id"), F.inline(every))


def images_of(pixels: DataFrame) -> DataFrame:
    """(img_id, height, width, channels, pixels): an image a row."""
    place = F.struct("y", "x", F.array(*CHANNELS).alias("v"))
    rows = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sort_array(F.collect_list(place)).alias("p"))
    return rows.select("img_id", "height", "width", F.lit(3).alias("channels"), F.flatten(F.transform("p", lambda p: p["v"])).alias("pixels"))


def render_folder(spark: SparkSession, folder: str, pipe: Pipeline, extension: str, scale: float = 1.0, most: tuple[int, int] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(path, content) of every readable image after the edit, and (path, error) of the others. ``most`` bounds height and width; sizes are rendered one after the other, as each has its own tiles."""
    decoded = materialize(files.read_images(spark, folder), "decoded")
    out = None
    sizes = decoded.where("error is null").select("height", "width").distinct().orderBy("height", "width").collect()  # a row per size of image
    for h, w in sizes:
        s = min(scale, *(m / n for m, n in zip(most, (h, w), strict=True))) if most else scale
        some = decoded.where((F.col("height") == h) & (F.col("width") == w) & F.col("error").isNull())
        px = pipe.render(pixels_of(some), h, w, s)
        px = px if pipe.coded() else color.linear_to_srgb(Plan()).apply(px)
        px = px.select("img_id", "y", "x", *((F.col(c) / 255 if pipe.is_enabled("gamma") else F.col(c)).alias(c) for c in CHANNELS))
        rows = images_of(px).join(some.select(F.xxhash64("path").alias("img_id"), "path"), "img_id").drop("img_id")
        done = files.encode_images(rows, extension, **options)
        out = done if out is None else out.unionByName(done)
    bad = decoded.where("error is not null").select("path", "error")
    return out if out is not None else spark.createDataFrame([], "path string, content binary"), bad


def write_files(rendered: DataFrame, root: str, target: str, extension: str) -> int:
    """Write the files below ``target`` where they were below ``root``; how many they are."""

    def run(batches):
        import pandas as pd

        for f in batches:
            for path, content in zip(f.path, f.content, strict=True):
                name = os.path.splitext(path.split(root.rstrip("/"), 1)[-1].lstrip("/"))[0] + "." + extension
                place = os.path.join(target, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place + ".part", "wb") as out:
                    out.write(bytes(content))
                os.replace(place + ".part", place)  # whole files only, also if a task runs again
            yield pd.DataFrame({"n": [len(f)]})

    return rendered.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumigrid", description=__doc__.splitlines()[0])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--history", help="an edit as a JSON document; else only what is on by default")
    p.add_argument("--extension", default="png", choices=sorted(files.WRITERS))
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--width", type=int)
    p.add_argument("--height", type=int)
    p.add_argument("--quality", type=int, default=95)
    a = p.parse_args(argv)
    pipe = Pipeline.create(defaults=())
    if a.history:
        with open(a.history, encoding="utf-8") as f:
            pipe = Pipeline.from_json(f.read())
    spark = SparkSession.builder.getOrCreate()
    most = (a.height or 1 << 30, a.width or 1 << 30) if a.height or a.width else None
    options = {"quality": a.quality} if a.extension in ("jpg", "jpeg") else {}
    rendered, bad = render_folder(spark, a.source, pipe, a.extension, a.scale, most, **options)
    n, failed = write_files(rendered, a.source, a.target, a.extension), bad.count()
    for r in bad.limit(100).toLocalIterator():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    print(f"{n} written, {failed} not readable")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
