"""The facade: load images, build and change pipelines, render, export; and a scripted catalog."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kernels, pixels, sets
from .plans.catalog import Catalog
from .plans.collection import Collection
from .plans.layers import Plan
from .plans.pipeline import Pipeline, PipelineError
from .sources import images as files, jpeg
from .sources import sidecars
from .streaming.windows import Events

# Result codes of the facade's errors.
OK, GENERIC, INVALID_ARGUMENT, NOT_FOUND, IO, FORMAT = 0, -1, -2, -3, -4, -5
MODULE, PARAM_TYPE, RENDER, EXPORT = -9, -10, -11, -12


class EngineError(RuntimeError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Image:
    """One decoded image: pixels as rows, its size, and what its metadata say."""

    def __init__(self, frame: DataFrame, height: int, width: int, maker: str | None = None, model: str | None = None):
        self.frame, self.height, self.width, self.maker, self.model = frame, height, width, maker, model


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.events, self.last_error = spark, Events(), ""

    def _fail(self, code: int, message: str):
        self.last_error = message
        raise EngineError(code, message)

    def load(self, path: str, img_id: int = 1) -> Image:
        """A file through Spark's reader; only formats with a decoder here."""
        rows = self.spark.read.format("binaryFile").load(path).select("path", "content").limit(1).collect()  # one file, chosen by the caller
        if not rows:
            self._fail(NOT_FOUND, f"{path} is not there")
        try:
            a = files.decode(rows[0]["path"], bytes(rows[0]["content"]))
        except ValueError as e:
            self._fail(FORMAT, str(e))
        image = self.from_array(a, img_id)
        if rows[0]["path"].lower().endswith((".jpg", ".jpeg", ".tif", ".tiff")):
            says = jpeg.read_exif(bytes(rows[0]["content"]))
            image.maker, image.model = says.get("maker"), says.get("model")
        return image

    def from_array(self, a: np.ndarray, img_id: int = 1) -> Image:
        a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
        h, w = a.shape[:2]
        y, x = np.indices((h, w))
        import pandas as pd

        frame = self.spark.createDataFrame(pd.DataFrame({"img_id": np.full(h * w, img_id), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "c0": a[..., 0].ravel(), "c1": a[..., 1].ravel(), "c2": a[..., 2].ravel()}))
        return Image(frame, h, w)

    def pipeline(self, order: str = "v5.0 RAW") -> Pipeline:
        return Pipeline.create(order)

    def render(self, image: Image, pipe: Pipeline, scale: float = 1.0, region: tuple[int, int, int, int] | None = None) -> DataFrame:
        try:
            out = pipe.render(image.frame, image.height, image.width, scale, region)
        except PipelineError as e:
            self._fail(RENDER, str(e))
        self.events.fire("pipe-complete", pipe)
        return out

    def export(self, image: Image, pipe: Pipeline, extension: str = "png", scale: float = 1.0, bits: int = 8, quality: int = 95) -> bytes:
        """One rendered image as a file's bytes, in display coding."""
        from .functions import color

        if extension not in files.WRITERS:
            self._fail(EXPORT, f"no encoder for {extension}")
        out = self.render(image, pipe, scale)
        rows = (out if pipe.coded() else color.linear_to_srgb(Plan()).apply(out)).toPandas()  # one image
        a = np.zeros((rows.y.max() + 1, rows.x.max() + 1, 3))
        a[rows.y, rows.x] = rows[["c0", "c1", "c2"]].to_numpy() / (255 if pipe.is_enabled("gamma") else 1)
        options = {"bits": bits} if extension in ("png", "ppm", "pnm", "tif", "tiff") else {"quality": quality} if extension in ("jpg", "jpeg") else {}
        return files.WRITERS[extension](np.clip(a, 0, 1), **options)

    def load_history(self, text: str) -> Pipeline:
        try:
            return Pipeline.from_json(text)
        except PipelineError as e:
            self._fail(FORMAT, str(e))

    def load_xmp(self, text: str, order: str = "v5.0 RAW") -> tuple[Pipeline, list[str]]:
        """A pipeline with the sidecar's operators on or off, and the operators it does not know."""
        try:
            entries = sidecars.read_xmp(text)
        except ValueError as e:
            self._fail(FORMAT, str(e))
        pipe, unknown = Pipeline.create(order), []
        known = {s.name for s in pipe.stages}
        for e in entries:
            if e["operation"] in known:
                pipe.enable(e["operation"], e["enabled"])
            else:
                unknown.append(e["operation"])
        return pipe, unknown

    def save_xmp(self, pipe: Pipeline) -> str:
        return sidecars.write_xmp([{"operation": s.name, "enabled": s.enabled, "multi_priority": s.instance} for s in pipe.stages if s.enabled])

    def modules(self) -> list[str]:
        return sorted({*pixels.POINT_OPS, *kernels.KERNELS, *kernels.WARPS, *kernels.WHOLE})

    def register_point(self, name: str, make: Callable[..., Plan], space: str = "RGB") -> None:
        """A new pointwise operator, used like the built-in ones."""
        pixels.POINT_OPS[name] = pixels.PointOp(name, make, space)

    def register_kernel(self, name: str, run: Callable, halo: int) -> None:
        kernels.KERNELS[name] = kernels.Kernel(name, run, halo)


class Library:
    """Scripting over a catalog; every change replaces a table by its next version."""

    def __init__(self, catalog: Catalog, events: Events | None = None):
        self.catalog, self.events = catalog, events or Events()

    def collection(self, spec: Collection) -> DataFrame:
        return spec.query(self.catalog)

    def image(self, imgid: int) -> DataFrame:
        return self.catalog.view().where(F.col("id") == imgid)

    def _put(self, table: str, df: DataFrame, event: str = "collection-changed") -> None:
        self.catalog.tables[table] = df
        self.events.fire(event, table)

    def select(self, chosen: DataFrame) -> None:
        self._put("selected_images", chosen.select("imgid").distinct(), "selection-changed")

    def attach_tag(self, chosen: DataFrame, tagid: int) -> None:
        self._put("tagged_images", sets.attach(self.catalog["tagged_images"], chosen, [tagid]))

    def detach_tag(self, chosen: DataFrame, tagid: int) -> None:
        self._put("tagged_images", sets.detach(self.catalog["tagged_images"], chosen, tagid))

    def rate(self, chosen: DataFrame, stars: int) -> None:
        self._put("images", sets.rate(self.catalog["images"], chosen, stars))

    def group_with(self, chosen: DataFrame, leader: int) -> None:
        self._put("images", sets.regroup(self.catalog["images"], chosen, leader), "image-group-information-changed")

    def duplicate(self, chosen: DataFrame) -> None:
        self._put("images", sets.duplicate(self.catalog["images"], chosen))

    def delete(self, chosen: DataFrame) -> None:
        images = self.catalog["images"]
        self._put("images", images.join(chosen.select(F.col("imgid").alias("id")), "id", "left_anti"))

    def move(self, chosen: DataFrame, film_id: int) -> None:
        images = self.catalog["images"]
        c = chosen.select(F.col("imgid").alias("id")).distinct().withColumn("_c", F.lit(True))
        self._put("images", images.join(c, "id", "left").withColumn("film_id", F.when(F.col("_c"), F.lit(film_id).cast("long")).otherwise(F.col("film_id"))).select(*images.columns))

    def apply_style(self, style: DataFrame, chosen: DataFrame) -> None:
        self._put("history", sets.apply_style(self.catalog["history"], style, chosen), "image-history-changed")
