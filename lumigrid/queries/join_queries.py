"""Queries for joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins
from ..plans.collection import Collection
from ..plans.roles import catalog, oracle

QUERIES, ORACLE_SQL = {}, {}


def _add(tables, sql):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (oracle(*tables) if tables else "") + sql
        return f

    return register


_KEPT = "(SELECT * FROM images WHERE (flags & 256) = 0)"


@_add(("images", "models", "presets"), f"SELECT i.id, p.id AS preset_id FROM {_KEPT} i JOIN models m ON m.id = i.model_id JOIN presets p ON i.iso BETWEEN iso_min AND iso_max AND exposure BETWEEN exposure_min AND exposure_max AND aperture BETWEEN aperture_min AND aperture_max AND focal_length BETWEEN focal_length_min AND focal_length_max AND m.name ILIKE p.model")
def join_preset_ranges(spark, folder):
    cat = catalog(spark, folder)
    images = Collection().where(cat).join(cat["models"].select(F.col("id").alias("model_id"), F.col("name").alias("image_model")), "model_id")
    return joins.matching_presets(images, cat["presets"]).select("id", "preset_id")


@_add(("images", "models", "presets", "history"), f"SELECT i.id, p.id AS preset_id, p.operation, row_number() OVER (PARTITION BY i.id, p.operation ORDER BY p.id) - 1 AS instance FROM {_KEPT} i JOIN models m ON m.id = i.model_id JOIN presets p ON i.iso BETWEEN iso_min AND iso_max AND exposure BETWEEN exposure_min AND exposure_max AND aperture BETWEEN aperture_min AND aperture_max AND focal_length BETWEEN focal_length_min AND focal_length_max AND m.name ILIKE p.model WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.imgid = i.id AND h.operation = p.operation)")
def window_instance_numbers(spark, folder):
    """Auto-applied presets for operations that an image's history lacks, numbered per operation."""
    cat = catalog(spark, folder)
    images = Collection().where(cat).join(cat["models"].select(F.col("id").alias("model_id"), F.col("name").alias("image_model")), "model_id")
    found = joins.matching_presets(images, cat["presets"]).select("id", "preset_id", "operation")
    done = cat["history"].select(F.col("imgid").alias("id"), "operation").distinct()
    number = F.row_number().over(Window.partitionBy("id", "operation").orderBy("preset_id")) - 1
    return found.join(done, ["id", "operation"], "left_anti").select("id", "preset_id", "operation", number.alias("instance"))


@_add(("images", "locations"), "SELECT id, tagid FROM images i JOIN locations l ON CASE WHEN type = 0 THEN (i.longitude - l.longitude) * (i.longitude - l.longitude) / (delta1 * delta1) + (i.latitude - l.latitude) * (i.latitude - l.latitude) / (delta2 * delta2) <= 1 ELSE abs(i.longitude - l.longitude) <= delta1 AND abs(i.latitude - l.latitude) <= delta2 END")
def join_locations(spark, folder):
    cat = catalog(spark, folder)
    return joins.locate(cat["images"], cat["locations"])


@_add(("images", "locations"), "SELECT tagid, count(DISTINCT id) AS n FROM images i JOIN locations l ON CASE WHEN type = 0 THEN (i.longitude - l.longitude) * (i.longitude - l.longitude) / (delta1 * delta1) + (i.latitude - l.latitude) * (i.latitude - l.latitude) / (delta2 * delta2) <= 1 ELSE abs(i.longitude - l.longitude) <= delta1 AND abs(i.latitude - l.latitude) <= delta2 END GROUP BY 1")
def location_counts(spark, folder):
    cat = catalog(spark, folder)
    return joins.locate(cat["images"], cat["locations"]).groupBy("tagid").agg(F.countDistinct("id").alias("n"))


_TRACK = "SELECT user_id AS k, event_id, epoch_us(ts) AS t, 10 + (event_id % 50) * 0.001 AS lat, 20 + (event_id % 70) * 0.001 AS lon FROM events"


@_add((), f"WITH track AS ({_TRACK} WHERE event_type <> 'view'), wanted AS (SELECT k, event_id AS id, t FROM ({_TRACK} WHERE event_type = 'view')), a AS (SELECT w.*, p.t AS t0, p.lat AS lat0, p.lon AS lon0 FROM wanted w ASOF LEFT JOIN (SELECT * FROM track) p ON w.k = p.k AND w.t >= p.t), b AS (SELECT a.*, q.t AS t1, q.lat AS lat1, q.lon AS lon1 FROM a ASOF LEFT JOIN track q ON a.k = q.k AND a.t <= q.t) SELECT k, id, t, round(CASE WHEN t0 IS NULL THEN lat1 WHEN t1 IS NULL OR t0 = t THEN lat0 WHEN t1 = t0 THEN lat0 ELSE lat0 + (lat1 - lat0) * ((t - t0) / (t1 - t0)) END, 7) AS lat, round(CASE WHEN t0 IS NULL THEN lon1 WHEN t1 IS NULL OR t0 = t THEN lon0 WHEN t1 = t0 THEN lon0 ELSE lon0 + (lon1 - lon0) * ((t - t0) / (t1 - t0)) END, 7) AS lon, coalesce((t0 IS NOT NULL AND t1 IS NOT NULL) OR t0 = t, false) AS found FROM b WHERE t0 IS NOT NULL OR t1 IS NOT NULL")
def join_as_of_track(spark, folder):
    """Events of one kind placed on the track that each user's other events make."""
    e = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("t"), (10 + F.col("event_id") % 50 * 0.001).alias("lat"), (20 + F.col("event_id") % 70 * 0.001).alias("lon"))
    placed = joins.as_of_track(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), by=["k"], near=1e9)
    return placed.where("lat is not null").select("k", "id", "t", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "found")


_GREAT = "2 * 6378100.0 * asin(sqrt(least(1.0, pow(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon0) / 2), 2))))"
_FAR = "SELECT event_id, user_id % 3 AS k, epoch_us(ts) AS t, CAST((event_id * 37) % 120 - 60 AS DOUBLE) AS lat, CAST((event_id * 53) % 340 - 170 AS DOUBLE) AS lon FROM events"


@_add((), f"WITH track AS ({_FAR} WHERE event_id % 5 = 0), one AS (SELECT t, max((lat, lon)) AS hi, min((lat, lon)) AS lo FROM track GROUP BY t), wanted AS ({_FAR} WHERE event_id % 5 = 1), a AS (SELECT w.event_id AS id, w.t, p.t AS t0, p.hi[1] AS lat0, p.hi[2] AS lon0 FROM wanted w ASOF LEFT JOIN one p ON w.t >= p.t), b AS (SELECT a.*, q.t AS t1, q.lo[1] AS lat1, q.lo[2] AS lon1 FROM a ASOF LEFT JOIN one q ON a.t <= q.t), d AS (SELECT *, CASE WHEN t1 = t0 THEN 0.0 ELSE (t - t0) / (t1 - t0) END AS part, {_GREAT} / 6378100.0 AS d FROM b WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t0 <> t), v AS (SELECT *, CASE WHEN sin(d) = 0 THEN 1.0 ELSE sin(d) END AS s FROM d), xyz AS (SELECT *, (sin((1 - part) * d) * cos(radians(lat0)) * cos(radians(lon0)) + sin(part * d) * cos(radians(lat1)) * cos(radians(lon1))) / s AS x, (sin((1 - part) * d) * cos(radians(lat0)) * sin(radians(lon0)) + sin(part * d) * cos(radians(lat1)) * sin(radians(lon1))) / s AS y, (sin((1 - part) * d) * sin(radians(lat0)) + sin(part * d) * sin(radians(lat1))) / s AS z FROM v) SELECT id, t, round(CASE WHEN d * 6378100.0 < 10000 THEN lat0 + (lat1 - lat0) * part ELSE degrees(atan2(z, sqrt(x * x + y * y))) END, 6) + 0.0 AS lat, round(CASE WHEN d * 6378100.0 < 10000 THEN lon0 + (lon1 - lon0) * part ELSE degrees(atan2(y, x)) END, 6) + 0.0 AS lon FROM xyz")
def join_as_of_great_circle(spark, folder):
    """One track for all, its points far apart: places between two of them, on great circles."""
    e = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("t"), ((F.col("event_id") * 37) % 120 - 60).cast("double").alias("lat"), ((F.col("event_id") * 53) % 340 - 170).cast("double").alias("lon"))
    track = e.where("id % 5 = 0")
    placed = joins.as_of_track(e.where("id % 5 = 1"), track)
    exact = track.select(F.col("t").cast("long").alias("_t")).distinct()
    return placed.where("found").join(exact, F.col("t") == F.col("_t"), "left_anti").selectExpr("id", "t", "round(lat, 6) + 0.0 AS lat", "round(lon, 6) + 0.0 AS lon")


@_add(("overlay",), "SELECT DISTINCT s.imgid AS start, s.imgid - k AS node FROM overlay s, range(1, 16) r(k) WHERE k <= s.imgid % 16 AND NOT EXISTS (SELECT 1 FROM range(0, k) q(j) WHERE j > 0 AND NOT EXISTS (SELECT 1 FROM overlay o WHERE o.imgid = s.imgid - j))")
def recursive_reachability(spark, folder):
    """Every image that a chain of overlays leads to, from every image that has one."""
    cat = catalog(spark, folder)
    return joins.reachable(cat["overlay"], cat["overlay"].select("imgid"))


@_add(("images",), "SELECT DISTINCT a.id, (SELECT min(c.id) FROM images c WHERE c.filename = a.filename AND c.film_id = a.film_id) AS first_id, (SELECT count(*) FROM images c WHERE c.filename = a.filename AND c.film_id = a.film_id) AS n FROM images a JOIN images b ON a.filename = b.filename AND a.film_id = b.film_id AND a.id <> b.id")
def join_duplicates(spark, folder):
    return joins.duplicates(catalog(spark, folder)["images"])


@_add(("images", "film_rolls", "models", "history_hash"), "SELECT id, 'film' AS kind FROM film_rolls WHERE id NOT IN (SELECT film_id FROM images) UNION ALL SELECT id, 'model' FROM models WHERE id NOT IN (SELECT model_id FROM images) UNION ALL SELECT id, 'image' FROM images WHERE id NOT IN (SELECT imgid FROM history_hash)")
def join_orphans(spark, folder):
    """Over whole tables; images that no hash refers to are those that are there."""
    cat = catalog(spark, folder)
    films = joins.orphans(cat["film_rolls"], "id", cat["images"], "film_id").select("id", F.lit("film").alias("kind"))
    models = joins.orphans(cat["models"], "id", cat["images"], "model_id").select("id", F.lit("model").alias("kind"))
    return films.unionAll(models).unionAll(joins.orphans(cat["images"], "id", cat["history_hash"], "imgid").select("id", F.lit("image").alias("kind")))


@_add(("images", "makers", "models", "lens", "film_rolls"), "SELECT i.id, mk.name AS maker, mo.name AS model, l.name AS lens, f.folder FROM images i LEFT JOIN makers mk ON mk.id = i.maker_id LEFT JOIN models mo ON mo.id = i.model_id LEFT JOIN lens l ON l.id = i.lens_id LEFT JOIN film_rolls f ON f.id = i.film_id")
def catalog_view(spark, folder):
    return catalog(spark, folder).view().select("id", "maker", "model", "lens", "folder")


@_add(("tagged_images",), "SELECT a.tagid AS tag1, b.tagid AS tag2, count(*) AS n FROM tagged_images a JOIN tagged_images b ON a.imgid = b.imgid AND a.tagid < b.tagid GROUP BY 1, 2")
def join_tag_pairs(spark, folder):
    links = catalog(spark, folder)["tagged_images"]
    return links.withColumnRenamed("tagid", "tag1").join(links.withColumnRenamed("tagid", "tag2"), "imgid").where("tag1 < tag2").groupBy("tag1", "tag2").agg(F.count(F.lit(1)).alias("n"))
