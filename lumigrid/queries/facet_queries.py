"""Queries for facets and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets
from ..plans.collection import Collection, Rule
from ..plans.roles import catalog, oracle

_ALL = Collection()
_BASE = "(SELECT * FROM images WHERE (flags & 256) = 0) i"
_TIME = "(TIMESTAMP '1970-01-01' + to_microseconds(datetime_taken - 62135596800000000))"


def _facet(make):
    def run(spark, folder):
        cat = catalog(spark, folder)
        return make(_ALL.where(cat), cat)

    return run


def _dim(table: str, key: str, name: str = "coalesce(trim(name), '')") -> tuple:
    return (table,), f"SELECT min(value) AS value, count(*) AS n FROM (SELECT {name} AS value FROM {_BASE} LEFT JOIN {table} d ON d.id = i.{key}) GROUP BY lower(value)"


_STATE = "CASE WHEN h.imgid IS NULL THEN 0 WHEN current_hash IS NOT DISTINCT FROM basic_hash THEN 1 WHEN current_hash IS NOT DISTINCT FROM auto_hash THEN 3 ELSE 2 END"
_RANGES = ["aperture", "exposure", "exposure_bias", "focal_length", "iso", "aspect_ratio", "datetime_taken", "import_timestamp", "change_timestamp", "export_timestamp", "print_timestamp"]
_TAG_LIST = "SELECT tagid, name, n, row_number() OVER (ORDER BY {}, tagid) AS place FROM (SELECT t.id AS tagid, name, (SELECT count(*) FROM tagged_images ti WHERE ti.tagid = t.id) AS n FROM tags t)"
_SUGGESTED = """, links AS (SELECT DISTINCT ti.imgid, ti.tagid FROM tagged_images ti JOIN tags t ON t.id = ti.tagid WHERE t.name NOT LIKE 'internal|%'),
taglist AS (SELECT tagid AS id, count(imgid) AS count, count(CASE WHEN imgid IN (SELECT imgid FROM selected_images) THEN 1 END) AS count2 FROM links GROUP BY tagid),
pairs AS (SELECT a.tagid AS tagid1, b.tagid AS tagid2, count(*) AS c12 FROM links a JOIN taglist t0 ON t0.id = a.tagid AND t0.count2 > 0 JOIN links b ON b.imgid = a.imgid AND b.tagid <> a.tagid GROUP BY 1, 2),
found AS (SELECT tagid2 FROM pairs JOIN taglist t1 ON t1.id = tagid1 JOIN taglist t2 ON t2.id = tagid2 WHERE t1.count - t1.count2 <> 0 AND 100 * c12 // (t1.count - t1.count2) >= 4 AND t2.count2 <> (SELECT count(*) FROM selected_images)
  UNION SELECT t.id FROM tags t JOIN taglist t2 ON t2.id = t.id WHERE t.name IN ('Places|City4', 'Places|City54') AND t2.count2 <> (SELECT count(*) FROM selected_images))
SELECT id AS tagid, count AS n, count2 AS n_selected FROM taglist WHERE id IN (SELECT tagid2 FROM found)"""
_FACETS = {
    "folder": (facets.folder, ("film_rolls",), f"SELECT folder, film_id, count(*) AS n FROM {_BASE} JOIN film_rolls f ON f.id = film_id GROUP BY folder, film_id"),
    "tag": (facets.tag, ("tags", "tagged_images"), f"SELECT name, count(*) AS n FROM {_BASE} JOIN tagged_images ti ON ti.imgid = i.id JOIN tags t ON t.id = ti.tagid WHERE name NOT LIKE 'internal|%' GROUP BY name, t.id UNION ALL SELECT NULL, count(*) FROM {_BASE} WHERE id NOT IN (SELECT imgid FROM tagged_images ti JOIN tags t ON t.id = ti.tagid WHERE name NOT LIKE 'internal|%')"),
    "geotag": (facets.geotag, (), f"SELECT CASE WHEN longitude IS NULL OR latitude IS NULL THEN 'not tagged' ELSE 'tagged' END AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "day": (lambda i, c: facets.day(i), (), f"SELECT datetime_taken // 86400000000 * 86400000000 AS value, count(*) AS n FROM {_BASE} WHERE datetime_taken IS NOT NULL AND datetime_taken <> 0 GROUP BY 1"),
    "change_timestamp": (lambda i, c: facets.moment(i, "change_timestamp"), (), f"SELECT change_timestamp AS value, count(*) AS n FROM {_BASE} WHERE change_timestamp IS NOT NULL AND change_timestamp <> 0 GROUP BY 1"),
    "import_timestamp": (lambda i, c: facets.moment(i, "import_timestamp"), (), f"SELECT import_timestamp AS value, count(*) AS n FROM {_BASE} WHERE import_timestamp IS NOT NULL AND import_timestamp <> 0 GROUP BY 1"),
    "camera": (facets.camera, *_dim("cameras", "camera_id", "trim(concat_ws(' ', maker, model))")),
    "lens": (facets.lens, *_dim("lens", "lens_id", "CASE WHEN lower(coalesce(trim(name), '')) = 'n/a' THEN '' ELSE coalesce(trim(name), '') END")),
    "history": (facets.history, ("history_hash",), f"SELECT {_STATE} AS force_order, count(*) AS n, CASE {_STATE} WHEN 3 THEN 'auto applied' WHEN 2 THEN 'altered' ELSE 'basic' END AS value FROM {_BASE} LEFT JOIN history_hash h ON h.imgid = i.id GROUP BY 1, 3"),
    "local_copy": (lambda i, c: facets.local_copy(i), (), f"SELECT CASE WHEN (flags & 2048) <> 0 THEN 'copied locally' ELSE 'not copied locally' END AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "color": (facets.color, ("color_labels",), f"SELECT color AS value, count(*) AS n FROM {_BASE} LEFT JOIN color_labels l ON l.imgid = i.id GROUP BY 1"),
    "exposure": (lambda i, c: facets.exposure(i), (), f"SELECT CASE WHEN exposure < 0.4 THEN concat('1/', CAST(trunc(1 / exposure + 0.9) AS INT)) ELSE concat(round(exposure, 2), '\"') END AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "rating": (lambda i, c: facets.stars(i), (), f"SELECT CAST(CASE WHEN (flags & 8) <> 0 THEN -1 ELSE flags & 7 END AS INT) AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "filename": (lambda i, c: facets.filename(i), (), f"SELECT filename AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "stem": (lambda i, c: facets.stem_and_extension(i)[0], (), f"SELECT regexp_replace(filename, '\\.[^.]*$', '') AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "extension": (lambda i, c: facets.stem_and_extension(i)[1], (), f"SELECT upper(regexp_extract(filename, '(\\.[^.]*)$', 1)) AS value, count(*) AS n FROM {_BASE} GROUP BY 1"),
    "metadata": (lambda i, c: facets.metadata(i, c, 0), ("meta_data",), f"SELECT value, count(*) AS n FROM {_BASE} LEFT JOIN (SELECT * FROM meta_data WHERE key = 0) m ON m.imgid = i.id GROUP BY 1"),
    "module": (facets.module, ("history",), f"SELECT operation AS value, count(DISTINCT imgid) AS n FROM {_BASE} JOIN history h ON h.imgid = i.id WHERE enabled = 1 GROUP BY 1"),
    "module_order": (facets.module_order, ("module_order",), f"SELECT o.version AS value, count(*) AS n FROM {_BASE} LEFT JOIN module_order o ON o.imgid = i.id GROUP BY 1"),
    "groups": (lambda i, c: facets.groups(i), (), f"SELECT group_id, count(*) AS n FROM {_BASE} GROUP BY 1 HAVING count(*) > 1"),
    "date_rollup": (lambda i, c: facets.rolled_up(i), (), f"SELECT y, m, d, count(*) AS n FROM (SELECT CAST(year({_TIME}) AS INT) AS y, CAST(month({_TIME}) AS INT) AS m, CAST(day({_TIME}) AS INT) AS d FROM {_BASE}) GROUP BY GROUPING SETS ((y), (y, m), (y, m, d))"),
    "path_rollup": (lambda i, c: facets.path_rollup(facets.folder(i, c)), ("film_rolls",), f"SELECT array_to_string(p[1:k], '/') AS prefix, count(*) AS n FROM (SELECT string_split(substr(folder, 2), '/') AS p FROM {_BASE} JOIN film_rolls f ON f.id = film_id), range(1, 4) r(k) WHERE k <= len(p) GROUP BY 1"),
    "date_bounds": (lambda i, c: facets.bounds(i, "datetime_taken"), (), f"SELECT min(datetime_taken) AS low, max(datetime_taken) AS high FROM {_BASE}"),
    "profile": (lambda i, c: facets.profile(i, ["film_id", "filename", "iso", "aperture", "camera_id", "lens_id", "width", "version"]), (), f"SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in ('film_id', 'filename', 'iso', 'aperture', 'camera_id', 'lens_id', 'width', 'version'))} FROM {_BASE}"),
    "geo_bounds": (lambda i, c: i.agg(F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.count("longitude").alias("n")), (), f"SELECT min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north, count(longitude) AS n FROM {_BASE}"),
    "tag_usage": (lambda i, c: facets.tag_usage(c, c["selected_images"]), ("tags", "tagged_images", "selected_images"), "SELECT t.id AS tagid, name, count(ti.imgid) AS n, count(s.imgid) AS n_selected FROM tags t LEFT JOIN tagged_images ti ON ti.tagid = t.id LEFT JOIN selected_images s ON s.imgid = ti.imgid GROUP BY 1, 2"),
    "attached_tags": (lambda i, c: facets.attached(c, c["selected_images"]), ("tagged_images", "selected_images"), "SELECT tagid, count(DISTINCT ti.imgid) AS n, CASE WHEN count(DISTINCT ti.imgid) = (SELECT count(*) FROM selected_images) THEN 'all' ELSE 'some' END AS state FROM tagged_images ti JOIN selected_images s ON s.imgid = ti.imgid GROUP BY 1"),
    "tag_subtree": (lambda i, c: facets.subtree(c, "Brand#1"), ("tags", "tagged_images"), "SELECT count(DISTINCT t.id) AS n_tags, count(DISTINCT imgid) AS n_images FROM tags t LEFT JOIN tagged_images ti ON ti.tagid = t.id WHERE name = 'Brand#1' OR name LIKE 'Brand#1|%'"),
    "tag_suggestions": (lambda i, c: facets.suggestions(c, c["selected_images"], 4, ("Places|City4", "Places|City54", "no such tag")), ("tags", "tagged_images", "selected_images"), _SUGGESTED),
    "tag_list_path": (lambda i, c: facets.tag_list(c, "path"), ("tags", "tagged_images"), _TAG_LIST.format("replace(name, '|', chr(1))")),
    "tag_list_leaf": (lambda i, c: facets.tag_list(c, "leaf"), ("tags", "tagged_images"), _TAG_LIST.format("string_split(name, '|')[-1], replace(name, '|', chr(1))")),
    "tag_list_count": (lambda i, c: facets.tag_list(c, "count"), ("tags", "tagged_images"), _TAG_LIST.format("n DESC, replace(name, '|', chr(1))")),
    "all_bounds": (lambda i, c: facets.all_bounds(i, _RANGES), (), " UNION ALL ".join(f"SELECT '{c}' AS filter, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM {_BASE}" for c in _RANGES)),
}
for _t, _k in (("whitebalance", "whitebalance_id"), ("flash", "flash_id"), ("exposure_program", "exposure_program_id"), ("metering_mode", "metering_mode_id")):
    _FACETS[_t] = ((lambda i, c, t=_t, k=_k: facets.plain_dimension(i, c, t, k)), *_dim(_t, _k))
for _p, _s in (("focal_length", "CAST(trunc(focal_length) AS INT)"), ("iso", "CAST(trunc(iso) AS INT)"), ("aperture", "round(aperture, 1)"), ("exposure_bias", "round(exposure_bias, 2)"), ("aspect_ratio", "round(aspect_ratio, 2)")):
    _FACETS[_p] = ((lambda i, c, p=_p: facets.numeric(i, p)), (), f"SELECT {_s} AS value, count(*) AS n FROM {_BASE} GROUP BY 1")

QUERIES = {f"facet_{n}": _facet(m) for n, (m, _, _) in _FACETS.items()}
ORACLE_SQL = {f"facet_{n}": oracle("images", *t).rstrip() + ("" if s.startswith(",") else " ") + s for n, (_, t, s) in _FACETS.items()}

_BARS = {
    "YEAR": "date_trunc('year', t)",
    "4MONTH": "make_timestamp(year(t), month(t) - (month(t) - 1) % 4, 1, 0, 0, 0)",
    "MONTH": "date_trunc('month', t)",
    "10DAY": "make_timestamp(year(t), month(t), least((day(t) - 1) - (day(t) - 1) % 10, 20) + 1, 0, 0, 0)",
    "DAY": "date_trunc('day', t)",
    "6HOUR": "make_timestamp(year(t), month(t), day(t), hour(t) - hour(t) % 6, 0, 0)",
    "HOUR": "date_trunc('hour', t)",
    "10MINUTE": "make_timestamp(year(t), month(t), day(t), hour(t), minute(t) - minute(t) % 10, 0)",
    "MINUTE": "date_trunc('minute', t)",
}


def _histogram(zoom: str):
    def run(spark, folder):
        cat = catalog(spark, folder)
        images = _ALL.where(cat).withColumn("shot", F.expr("datetime_taken + (id % 86400) * 1000000"))
        inside = Collection(rules=(Rule("iso", ">=400"),)).where(cat)
        return facets.time_histogram(images, zoom, inside, "shot")

    return run


for _z, _b in _BARS.items():
    QUERIES[f"time_histogram_{_z.lower()}"] = _histogram(_z)
    ORACLE_SQL[f"time_histogram_{_z.lower()}"] = oracle("images") + f"SELECT CAST({_b} AS TIMESTAMP) AS bar, count(*) AS n, count(CASE WHEN iso >= 400 THEN 1 END) AS n_inside FROM (SELECT iso, {_TIME} + to_seconds(id % 86400) AS t FROM images WHERE (flags & 256) = 0) GROUP BY 1"


def facet_leave_one_out(spark, folder):
    """Counts of ISO values under all rules but the one on ISO itself."""
    cat = catalog(spark, folder)
    spec = Collection(rules=(Rule("rating", ">=2"), Rule("iso", "400")))
    return facets.numeric(spec.without(1).where(cat), "iso")


QUERIES["facet_leave_one_out"] = facet_leave_one_out
ORACLE_SQL["facet_leave_one_out"] = oracle("images") + "SELECT CAST(trunc(iso) AS INT) AS value, count(*) AS n FROM images WHERE (flags & 256) = 0 AND (flags & 7) >= 2 AND (flags & 8) = 0 GROUP BY 1"
