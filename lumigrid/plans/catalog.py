"""The catalog: named tables of a photo library, and the fixed values of its encodings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of images.flags, label colours, the ways images are known to be unedited.
RATING_MASK, REJECTED, LDR, RAW, HDR, REMOVED, LOCAL_COPY, HAS_TXT, HAS_WAV, MONOCHROME = 7, 8, 32, 64, 128, 256, 2048, 4096, 8192, 32768
COLORS = ("red", "yellow", "green", "blue", "purple")
DAY = 86_400_000_000  # microseconds
MODULE_ORDERS = ("custom", "legacy", "v3.0 RAW", "v3.0 JPEG", "v5.0 RAW", "v5.0 JPEG")


def bits(column: str | Column, mask: int) -> Column:
    return (F.col(column) if isinstance(column, str) else column).bitwiseAND(F.lit(mask))


def rating(flags: str | Column = "flags") -> Column:
    """Stars, or -1 for a rejected image."""
    return F.when(bits(flags, REJECTED) != 0, F.lit(-1)).otherwise(bits(flags, RATING_MASK)).cast("int")


class Catalog:
    """Tables by name. A missing optional table raises KeyError when a rule needs it."""

    def __init__(self, tables: Mapping[str, DataFrame], internal_tags: str = "internal|", location_root: str = "internal|locations"):
        self.tables, self.internal_tags, self.location_root = dict(tables), internal_tags, location_root

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def user_tags(self) -> DataFrame:
        return self["tags"].where(~F.col("name").startswith(self.internal_tags))

    def view(self) -> DataFrame:
        """Images with their dimensions spelled out: maker, model, lens, camera and folder."""
        out = self["images"]
        for table, key, column, name in (("makers", "maker_id", "name", "maker"), ("models", "model_id", "name", "model"), ("lens", "lens_id", "name", "lens"), ("film_rolls", "film_id", "folder", "folder")):
            dim = self[table].select(F.col("id").alias(key), F.col(column).alias(name))
            out = out.join(dim, key, "left")
        return out
