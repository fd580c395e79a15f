"""Joins that Spark has no operator for: ranges, ellipses and polygons, time tracks, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize

EARTH = 6_378_100.0  # metres
#: Rows, counted, up to which a side of a join may be broadcast.
SMALL_ROWS = 50_000
DAY = 86_400_000_000  # microseconds


def interval_join(facts: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: float, extra: Column | None = None, most_buckets: int = 64) -> DataFrame:
    """facts whose ``point`` lies in [low, high], as an equi-join on buckets of ``width``.

    An interval over up to ``most_buckets`` buckets is listed under each of them, so the join never
    compares all with all. Wider intervals are cut along a coarser grid: widths grow by powers of
    ``most_buckets`` until they fit. Facts are read once, and stay where they are if the intervals'
    counted rows are within SMALL_ROWS, so that a bucket of many facts is no hot key.
    """
    span = (F.floor(F.col(high) / width) - F.floor(F.col(low) / width) + 1).cast("double")
    level = F.greatest(F.ceil(F.log(F.greatest(span, F.lit(1.0))) / F.log(F.lit(float(most_buckets))) - 1e-9).cast("int") - 1, F.lit(0))
    wide = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    grid = F.lit(width) * F.pow(F.lit(float(most_buckets)), F.col("_level"))
    wide = wide.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / grid).cast("long"), F.floor(F.col(high) / grid).cast("long"))))
    sizes = {r[0]: r[1] for r in wide.groupBy("_level").count().collect()}  # a handful: the logarithm of the widest span
    if not sizes:
        return facts.join(intervals, F.lit(False))
    places = F.array(*(F.struct(F.lit(n).alias("_level"), F.floor(F.col(point) / (width * most_buckets**n)).cast("long").alias("_bucket")) for n in sorted(sizes)))
    points = facts.select("*", F.inline(places))
    wide = F.broadcast(wide) if sum(sizes.values()) <= SMALL_ROWS else wide
    out = points.join(wide, ["_level", "_bucket"]).where(F.col(point).between(F.col(low), F.col(high)))
    out = out.where(extra) if extra is not None else out
    return out.drop("_level", "_bucket")


def matching_presets(images: DataFrame, presets: DataFrame) -> DataFrame:
    """Image-preset pairs whose ISO, exposure, aperture, focal length and model all fit."""
    fits = F.col("exposure").between(F.col("exposure_min"), F.col("exposure_max")) & F.col("aperture").between(F.col("aperture_min"), F.col("aperture_max")) & F.col("focal_length").between(F.col("focal_length_min"), F.col("focal_length_max")) & F.expr("image_model ILIKE preset_model")
    return interval_join(images, "iso", presets.withColumnRenamed("model", "preset_model").withColumnRenamed("id", "preset_id").withColumnRenamed("name", "preset_name"), "iso_min", "iso_max", 500.0, fits)


def in_ellipse(lon: Column, lat: Column, at: str = "") -> Column:
    x, y = lon - F.col(f"{at}longitude"), lat - F.col(f"{at}latitude")
    a, b = F.col(f"{at}delta1"), F.col(f"{at}delta2")
    return x * x / (a * a) + y * y / (b * b) <= 1


def in_rectangle(lon: Column, lat: Column, at: str = "") -> Column:
    return (F.abs(lon - F.col(f"{at}longitude")) <= F.col(f"{at}delta1")) & (F.abs(lat - F.col(f"{at}latitude")) <= F.col(f"{at}delta2"))


def in_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """Even-odd rule over an array of (lat, lon) structs: each edge that a ray to the east crosses turns the answer round."""
    last = F.element_at(polygon, -1)
    start = F.struct(F.lit(False).alias("inside"), last.alias("p"))

    def edge(acc, q):
        p = acc["p"]
        crosses = (p["lat"] > lat) != (q["lat"] > lat)
        east = lon < (p["lon"] - q["lon"]) * (lat - q["lat"]) / F.when(p["lat"] == q["lat"], F.lit(1.0)).otherwise(p["lat"] - q["lat"]) + q["lon"]
        return F.struct((acc["inside"] != (crosses & east)).alias("inside"), q.alias("p"))

    return F.when(F.size(polygon) >= 3, F.aggregate(polygon, start, edge)["inside"]).otherwise(F.lit(False))


def locate(images: DataFrame, locations: DataFrame, cell: float = 10.0) -> DataFrame:
    """(id, tagid) of images inside locations: type 0 is an ellipse, 1 a rectangle, 2 a polygon.

    Locations are listed under the longitude-latitude cells that their box touches, images under
    their own cell: an equi-join, then the exact test.
    """
    box = lambda c, d: F.sequence(F.floor((F.col(c) - F.col(d)) / cell).cast("int"), F.floor((F.col(c) + F.col(d)) / cell).cast("int"))
    places = locations.select(*(F.col(c).alias(f"l_{c}") for c in locations.columns))
    places = places.withColumn("_x", F.explode(box("l_longitude", "l_delta1"))).withColumn("_y", F.explode(box("l_latitude", "l_delta2")))
    points = images.where("longitude is not null and latitude is not null").select("id", "longitude", "latitude", F.floor(F.col("longitude") / cell).cast("int").alias("_x"), F.floor(F.col("latitude") / cell).cast("int").alias("_y"))
    lon, lat = F.col("longitude"), F.col("latitude")
    inside = F.when(F.col("l_type") == 0, in_ellipse(lon, lat, "l_")).otherwise(in_rectangle(lon, lat, "l_"))
    if "polygons" in locations.columns:
        inside = F.when(F.col("l_type") == 2, in_rectangle(lon, lat, "l_") & in_polygon(lon, lat, F.col("l_polygons"))).otherwise(inside)
    return points.join(places, ["_x", "_y"]).where(inside).select("id", F.col("l_tagid").alias("tagid"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def along_great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, part: Column) -> tuple[Column, Column]:
    a1, o1, a2, o2 = map(F.radians, (lat1, lon1, lat2, lon2))
    d = haversine(lat1, lon1, lat2, lon2) / EARTH
    safe = F.when(F.sin(d) == 0, F.lit(1.0)).otherwise(F.sin(d))
    a, b = F.sin((1 - part) * d) / safe, F.sin(part * d) / safe
    x = a * F.cos(a1) * F.cos(o1) + b * F.cos(a2) * F.cos(o2)
    y = a * F.cos(a1) * F.sin(o1) + b * F.cos(a2) * F.sin(o2)
    z = a * F.sin(a1) + b * F.sin(a2)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def as_of_track(images: DataFrame, track: DataFrame, by: list[str] | None = None, near: float = 10_000.0, span: int = DAY) -> DataFrame:
    """Where an image was taken: its time (``t``, microseconds) between two points of a track (t, lat, lon).

    Columns id, t, lat, lon, found. Between points closer than ``near`` metres the way is straight,
    else a great circle; outside the track the end point serves and found is false. With ``by``
    tracks are separate per key. Time is cut into spans; points and images of a span meet in one
    sorted pass, and the last point before and the first one after each span are carried into it, so
    neither a long track nor one without keys lands in one task. Points of one time rank by place.
    """
    by = by or []
    bin_ = F.floor(F.col("t") / span).alias("_bin")
    point = F.struct(F.col("t").cast("long").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("point")
    points = track.select(*by, bin_, F.col("t").cast("long").alias("t"), point, F.lit(None).cast("long").alias("id"), F.lit(0).alias("_kind"))
    wanted = images.select(*by, bin_, F.col("t").cast("long").alias("t"), F.lit(None).cast(dict(points.dtypes)["point"]).alias("point"), F.col("id").cast("long"), F.lit(1).alias("_kind"))
    rows = points.unionByName(wanted)
    spans = rows.groupBy(*by, "_bin").agg(F.min("point").alias("_first"), F.max("point").alias("_last"))  # a row for each span
    w = Window.partitionBy(*by).orderBy("_bin")
    # what follows is looked up in falling order: a frame that runs to the end is worked out anew for every row
    back = Window.partitionBy(*by).orderBy(F.desc("_bin"))
    spans = spans.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_bin").alias("_at"), F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_coming"))
    w = Window.partitionBy(*by, "_bin").orderBy("t", "_kind", "point")
    back = Window.partitionBy(*by, "_bin").orderBy(F.desc("t"), F.desc("_kind"), F.desc("point"))
    before = F.last("point", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("point", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("_a", before).withColumn("_b", after).where("_kind = 1")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_bin").eqNullSafe(F.col("_at")))
    out = met.join(spans, same, "left").withColumn("_a", F.coalesce("_a", "_carried")).withColumn("_b", F.coalesce("_b", "_coming"))

    def between(s):
        a, b, t = s["a"], s["b"], s["t"]
        part = F.when(b["t"] == a["t"], F.lit(0.0)).otherwise((t - a["t"]) / (b["t"] - a["t"]))

        def along(m):
            lat, lon = along_great_circle(a["lat"], a["lon"], b["lat"], b["lon"], m["part"])
            straight = lambda c: a[c] + (b[c] - a[c]) * m["part"]
            return F.when(m["way"] < near, F.struct(straight("lat").alias("lat"), straight("lon").alias("lon"))).otherwise(F.struct(lat.alias("lat"), lon.alias("lon")))

        place = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
        measured = F.struct(part.alias("part"), haversine(a["lat"], a["lon"], b["lat"], b["lon"]).alias("way"))
        return F.when(a["t"] == t, place(a)).when(a.isNull(), place(b)).when(b.isNull(), place(a)).otherwise(_bound(measured, along))

    found = F.coalesce((F.col("_a.t") == F.col("t")) | (F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.lit(False))
    out = out.select(*by, "id", "t", _bound(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("t").alias("t")), between).alias("_place"), found.alias("found"))
    return out.select(*by, "id", "t", "_place.lat", "_place.lon", "found")


def reachable(edges: DataFrame, starts: DataFrame, source: str = "imgid", target: str = "overlay_id", most_rounds: int = 1_000) -> DataFrame:
    """(start, node): all nodes on directed paths from each start, cycles included, by rounds of frontier joins over written tables."""
    write = lambda df: materialize(df, "frontier")
    edges = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct()
    seen = frontier = write(starts.select(F.col(starts.columns[0]).alias("start")).distinct().join(edges, F.col("start") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct())
    for _ in range(most_rounds):
        step = frontier.join(edges, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        frontier = write(step.join(seen, ["start", "node"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = write(seen.unionByName(frontier))
    raise RuntimeError(f"paths longer than {most_rounds}")


def would_cycle(edges: DataFrame, image: int, overlay: int) -> bool:
    """Whether an edge image -> overlay would close a cycle."""
    if image == overlay:
        return True
    start = edges.sparkSession.createDataFrame([(overlay,)], "start long")
    return bool(reachable(edges, start).where(F.col("node") == image).limit(1).count())


def duplicates(images: DataFrame) -> DataFrame:
    """(id, first_id, n): every image whose file name occurs again in its film roll, the first of them, and how many they are. Groups, not pairs, so the result grows with the images."""
    groups = images.groupBy("filename", "film_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return images.select("filename", "film_id", "id").join(groups, ["filename", "film_id"]).select("id", "first_id", "n")


def orphans(parents: DataFrame, key: str, children: DataFrame, reference: str) -> DataFrame:
    """Parents that no child refers to."""
    used = children.select(F.col(reference).alias("_used"))
    return parents.join(used, F.col(key) == F.col("_used"), "left_anti")
