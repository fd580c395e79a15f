"""Facets: how many images of a collection hold each value of a property.

Each is one partial-then-final aggregation; dimension tables join after aggregating, when only
a row per key is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..plans.catalog import DAY, LOCAL_COPY, Catalog, bits, rating

def N() -> Column:  # noqa: N802
    return F.count(F.lit(1)).alias("n")



def by(images: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return images.groupBy(value.alias(name)).agg(N())


def dimension(images: DataFrame, catalog: Catalog, table: str, key: str, name: Column) -> DataFrame:
    """Counts per spelled-out name; keys are counted first, names that differ only in case are one."""
    counts = images.groupBy(F.col(key).alias("id")).agg(N())
    named = counts.join(catalog[table], "id", "left").select(name.alias("value"), "n")
    return named.groupBy(F.lower("value").alias("_k")).agg(F.min("value").alias("value"), F.sum("n").alias("n")).select("value", "n")


def folder(images: DataFrame, catalog: Catalog) -> DataFrame:
    counts = images.groupBy(F.col("film_id").alias("id")).agg(N())
    return counts.join(catalog["film_rolls"], "id").select("folder", F.col("id").alias("film_id"), "n")


def camera(images: DataFrame, catalog: Catalog) -> DataFrame:
    return dimension(images, catalog, "cameras", "camera_id", F.trim(F.concat_ws(" ", "maker", "model")))


def lens(images: DataFrame, catalog: Catalog) -> DataFrame:
    name = F.coalesce(F.trim("name"), F.lit(""))
    return dimension(images, catalog, "lens", "lens_id", F.when(F.lower(name) == "n/a", "").otherwise(name))


def plain_dimension(images: DataFrame, catalog: Catalog, table: str, key: str) -> DataFrame:
    return dimension(images, catalog, table, key, F.coalesce(F.trim("name"), F.lit("")))


def tag(images: DataFrame, catalog: Catalog, insensitive: bool = False) -> DataFrame:
    """Counts per user tag, and one row (null tag) for images without any."""
    links = catalog["tagged_images"].join(images.select(F.col("id").alias("imgid")), "imgid", "left_semi")
    user = catalog.user_tags().select(F.col("id").alias("tagid"), "name")
    counts = links.groupBy("tagid").agg(N()).join(user, "tagid")
    if insensitive:
        counts = counts.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name"), F.sum("n").alias("n"))
    tagged = catalog["tagged_images"].join(user, "tagid", "left_semi").select("imgid")
    bare = images.join(tagged, images.id == tagged.imgid, "left_anti").agg(N()).select(F.lit(None).cast("string").alias("name"), "n")
    return counts.select("name", "n").unionAll(bare)


def geotag(images: DataFrame, catalog: Catalog) -> DataFrame:
    """Not tagged, tagged, or the location's name."""
    root = catalog.location_root
    places = catalog["tagged_images"].join(catalog["tags"].where(F.col("name").startswith(root + "|")), F.col("tagid") == F.col("id")).groupBy("imgid").agg(F.min("name").alias("place"))
    out = images.join(places, images.id == places.imgid, "left")
    label = F.when(F.col("longitude").isNull() | F.col("latitude").isNull(), "not tagged").when(F.col("place").isNull(), "tagged").otherwise(F.substring("place", len(root) + 2, 1_000_000))
    return by(out, label)


def day(images: DataFrame, column: str = "datetime_taken") -> DataFrame:
    """Start of the day in microseconds; unset times (null, 0) are left out."""
    return by(images.where(F.col(column).isNotNull() & (F.col(column) != 0)), F.expr(f"{column} div {DAY}") * DAY)


def moment(images: DataFrame, column: str) -> DataFrame:
    return by(images.where(F.col(column).isNotNull() & (F.col(column) != 0)), F.col(column))


def history(images: DataFrame, catalog: Catalog) -> DataFrame:
    """Basic, auto applied, altered; images without a history row are basic in a row of their own."""
    h = catalog["history_hash"]
    current, basic, auto = F.col("current_hash"), F.col("basic_hash"), F.col("auto_hash")
    state = F.when(F.col("imgid").isNull(), 0).when(current.eqNullSafe(basic), 1).when(current.eqNullSafe(auto), 3).otherwise(2)
    out = by(images.join(h, images.id == h.imgid, "left"), state, "force_order")
    label = F.when(F.col("force_order") <= 1, "basic").when(F.col("force_order") == 3, "auto applied").otherwise("altered")
    return out.withColumn("value", label)


def local_copy(images: DataFrame) -> DataFrame:
    return by(images, F.when(bits("flags", LOCAL_COPY) != 0, "copied locally").otherwise("not copied locally"))


def color(images: DataFrame, catalog: Catalog) -> DataFrame:
    labels = catalog["color_labels"]
    return by(images.join(labels, images.id == labels.imgid, "left"), F.col("color"))


def exposure(images: DataFrame) -> DataFrame:
    """As shown: 1/n below 0.4 seconds, else seconds with their mark."""
    e = F.col("exposure")
    shown = F.when(e < 0.4, F.concat(F.lit("1/"), (1 / e + 0.9).cast("int").cast("string"))).otherwise(F.concat(F.round(e, 2).cast("string"), F.lit('"')))
    return by(images, shown)


def numeric(images: DataFrame, prop: str) -> DataFrame:
    c = F.col(prop)
    shown = {"focal_length": c.cast("int"), "iso": c.cast("int"), "aperture": F.round(c, 1), "exposure_bias": F.round(c, 2), "aspect_ratio": F.round(c, 2)}[prop]
    return by(images, shown)


def stars(images: DataFrame) -> DataFrame:
    return by(images, rating())


def filename(images: DataFrame) -> DataFrame:
    return by(images, F.col("filename"))


def stem_and_extension(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts per name without extension, and per upper-case extension with its dot."""
    stem = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1)
    return by(images, stem), by(images, F.upper(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))


def metadata(images: DataFrame, catalog: Catalog, key: int) -> DataFrame:
    rows = catalog["meta_data"].where(F.col("key") == key)
    return by(images.join(rows, images.id == rows.imgid, "left"), F.col("value"))


def module(images: DataFrame, catalog: Catalog) -> DataFrame:
    """Images per operation, each image once."""
    rows = catalog["history"].where("enabled = 1").select("imgid", "operation").distinct()
    return rows.join(images.select(F.col("id").alias("imgid")), "imgid", "left_semi").groupBy(F.col("operation").alias("value")).agg(N())


def module_order(images: DataFrame, catalog: Catalog) -> DataFrame:
    rows = catalog["module_order"].withColumnRenamed("version", "_order")
    return by(images.join(rows, images.id == rows.imgid, "left"), F.col("_order"))


def groups(images: DataFrame) -> DataFrame:
    """Groups of more than one image."""
    return images.groupBy("group_id").agg(N()).where("n > 1")


def rolled_up(images: DataFrame, column: str = "datetime_taken") -> DataFrame:
    """Counts per day, month and year: a child counts for all its ancestors. There is no grand total."""
    t = F.expr(f"timestampadd(MICROSECOND, {column} - 62135596800000000, timestamp_ntz'1970-01-01')")
    parts = images.where(F.col(column).isNotNull() & (F.col(column) != 0)).select(F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("d"))
    return parts.rollup("y", "m", "d").agg(N(), F.grouping_id().alias("g")).where("g <> 7").drop("g")


def path_rollup(counts: DataFrame, path: str = "folder", separator: str = "/") -> DataFrame:
    """Counts of every prefix of a path, however deep, from counts of the whole paths."""
    parts = F.filter(F.split(path, f"[{separator}]"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return counts.select(F.explode(prefixes).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n"))


def bounds(images: DataFrame, column: str) -> DataFrame:
    return images.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def profile(images: DataFrame, columns: list[str]) -> DataFrame:
    """How many distinct values each column has: one row, to tell "various values" from a common one."""
    return images.agg(*(F.countDistinct(c).alias(c) for c in columns))


#: Widths of a time histogram's bars.
ZOOMS = ("YEAR", "4MONTH", "MONTH", "10DAY", "DAY", "6HOUR", "HOUR", "10MINUTE", "MINUTE")


def _bar(t: Column, zoom: str) -> Column:
    if zoom == "4MONTH":
        return F.make_timestamp_ntz(F.year(t), F.month(t) - (F.month(t) - 1) % 4, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if zoom == "10DAY":
        start = F.least((F.day(t) - 1) - (F.day(t) - 1) % 10, F.lit(20)) + 1
        return F.make_timestamp_ntz(F.year(t), F.month(t), start, F.lit(0), F.lit(0), F.lit(0))
    if zoom in ("6HOUR", "10MINUTE"):
        hour = F.hour(t) - F.hour(t) % 6 if zoom == "6HOUR" else F.hour(t)
        minute = F.lit(0) if zoom == "6HOUR" else F.minute(t) - F.minute(t) % 10
        return F.make_timestamp_ntz(F.year(t), F.month(t), F.day(t), hour, minute, F.lit(0))
    return F.date_trunc(zoom, t).cast("timestamp_ntz")


def time_histogram(images: DataFrame, zoom: str, inside: DataFrame | None = None, column: str = "datetime_taken") -> DataFrame:
    """bar, n (of all) and n_inside (of those whose id is in ``inside``)."""
    t = F.expr(f"timestampadd(MICROSECOND, {column} - 62135596800000000, timestamp_ntz'1970-01-01')")
    rows = images.where(F.col(column).isNotNull() & (F.col(column) != 0)).select("id", _bar(t, zoom).alias("bar"))
    if inside is not None:
        flags = inside.select("id").distinct().withColumn("_in", F.lit(1))
        rows = rows.join(flags, "id", "left")
    else:
        rows = rows.withColumn("_in", F.lit(1))
    return rows.groupBy("bar").agg(N(), F.count("_in").alias("n_inside"))


def tag_usage(catalog: Catalog, selected: DataFrame) -> DataFrame:
    """Per tag: images with it, and how many of the selected ones."""
    links = catalog["tagged_images"].join(selected.select("imgid").distinct().withColumn("_s", F.lit(1)), "imgid", "left")
    counts = links.groupBy("tagid").agg(N(), F.count("_s").alias("n_selected"))
    return catalog["tags"].select(F.col("id").alias("tagid"), "name").join(counts, "tagid", "left").select("tagid", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_selected", F.lit(0)).alias("n_selected"))


def attached(catalog: Catalog, selected: DataFrame) -> DataFrame:
    """Tags on the selected images and whether all or some of them have it."""
    chosen = selected.select("imgid").distinct()
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    counts = catalog["tagged_images"].join(chosen, "imgid", "left_semi").groupBy("tagid").agg(F.countDistinct("imgid").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("tagid", "n", F.when(F.col("n") == F.col("total"), "all").otherwise("some").alias("state"))  # total is one row


def subtree(catalog: Catalog, root: str) -> DataFrame:
    tags = catalog["tags"].where((F.col("name") == root) | F.col("name").startswith(root + "|")).select(F.col("id").alias("tagid"))
    return tags.join(catalog["tagged_images"], "tagid", "left").agg(F.countDistinct("tagid").alias("n_tags"), F.countDistinct("imgid").alias("n_images"))


def suggestions(catalog: Catalog, selected: DataFrame, confidence: int = 50, recent: tuple[str, ...] = (), most_recent: int = 20) -> DataFrame:
    """(tagid, n, n_selected): tags that go with the selected images' tags, and recently used ones.

    A tag goes with another one of the selection if the images that hold both are, in whole percent,
    at least ``confidence`` of the images outside the selection that hold the other. Internal tags and
    tags on every selected image are left out. Of the recent names the first ``most_recent`` by name
    are offered whatever they go with. The self-join runs over images that share a tag with the selection.
    """
    user = catalog.user_tags().select(F.col("id").alias("tagid"), "name")
    links = catalog["tagged_images"].select("imgid", "tagid").join(user.select("tagid"), "tagid", "left_semi")
    chosen = selected.select("imgid").distinct()
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    marked = links.join(chosen.withColumn("_s", F.lit(1)), "imgid", "left")
    counts = marked.groupBy("tagid").agg(N(), F.count("_s").alias("n_selected")).crossJoin(F.broadcast(total))  # total is one row
    firsts = counts.where("n_selected > 0 and n <> n_selected").select(F.col("tagid").alias("tag1"), (F.col("n") - F.col("n_selected")).alias("outside"))
    pairs = links.withColumnRenamed("tagid", "tag1").join(firsts.select("tag1"), "tag1", "left_semi").join(links.withColumnRenamed("tagid", "tag2"), "imgid").where("tag1 <> tag2")
    shared = pairs.groupBy("tag1", "tag2").agg(F.count(F.lit(1)).alias("both"))
    going = shared.join(firsts, "tag1").where(F.expr("100 * both div outside") >= confidence).select(F.col("tag2").alias("tagid"))
    free = counts.where("n_selected <> total").select("tagid", "n", "n_selected")
    used = user.where(F.col("name").isin(*recent)).join(free, "tagid", "left_semi").orderBy("name", "tagid").limit(most_recent).select("tagid")
    return free.join(going.union(used).distinct(), "tagid", "left_semi")


def tag_list(catalog: Catalog, by: str = "path") -> DataFrame:
    """(tagid, name, n, place): all tags in order, by path (children right behind their parent), by their last part, or the most used first."""
    counts = catalog["tagged_images"].groupBy("tagid").agg(N())
    rows = catalog["tags"].select(F.col("id").alias("tagid"), "name").join(counts, "tagid", "left").select("tagid", "name", F.coalesce("n", F.lit(0)).alias("n"))
    path = F.replace("name", F.lit("|"), F.lit("\x01"))
    keys = {"path": [path], "leaf": [F.element_at(F.split("name", r"\|"), -1), path], "count": [F.col("n").desc(), path]}[by]
    return global_rank(rows, [*keys, F.col("tagid")], "place")


def all_bounds(images: DataFrame, columns: list[str]) -> DataFrame:
    """(filter, low, high): the ends of every filter's range, in one pass."""
    ends = images.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    return ends.select(F.inline(F.array(*(F.struct(F.lit(c).alias("filter"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in columns))))
