"""Queries for rules, orders and paging, each with the SQL it must agree with."""

from __future__ import annotations

from ..plans.collection import Collection, Rule, Sort
from ..plans.roles import catalog, oracle

Y = "'%Y-%m-%d'"


def _us(moment: str) -> str:
    """Microseconds since year 1 of a timestamp, in the oracle's SQL."""
    return f"(epoch_us(TIMESTAMP '{moment}') + 62135596800000000)"


def _in(query: str, key: str = "id", no: bool = False) -> str:
    return f"{key} {'NOT ' * no}IN ({query})"


_TAGGED = "SELECT imgid FROM tagged_images ti JOIN tags t ON t.id = ti.tagid WHERE "
_ROLL = "SELECT id FROM film_rolls WHERE "
_STARS, _REJECTED = "(flags & 7)", "(flags & 8) <> 0"
_MASK = "SELECT imgid FROM (SELECT imgid, sum(1 << color)::BIGINT AS mask FROM color_labels GROUP BY imgid) WHERE "
_ALTERED = "(basic_hash IS NULL OR current_hash <> basic_hash)"
_LENS = "SELECT id FROM lens WHERE "

#: name -> (rules or text pairs, tables besides images, the condition in SQL)
PREDICATES: dict[str, tuple[tuple, tuple, str]] = {
    "filmroll": ((("filmroll", "%asia%"),), ("film_rolls",), _in(_ROLL + "folder ILIKE '%asia%'", "film_id")),
    "folder_tree": ((("folders", "/photos/ASIA*"),), ("film_rolls",), _in(_ROLL + "folder ILIKE '/photos/asia' OR folder ILIKE '/photos/asia/%'", "film_id")),
    "folder_below": ((("folders", "/photos|%"),), ("film_rolls",), _in(_ROLL + "folder ILIKE '/photos/%'", "film_id")),
    "folder_exact": ((("folders", "/photos/ASIA/NATION_2"),), ("film_rolls",), _in(_ROLL + "folder ILIKE '/photos/asia/nation_2'", "film_id")),
    "color_any": ((("color", "%"),), ("color_labels",), _in("SELECT imgid FROM color_labels")),
    "color_named": ((("color", "green"),), ("color_labels",), _in("SELECT imgid FROM color_labels WHERE color = 2")),
    "color_mask_and": ((("color", "0x80004003"),), ("color_labels",), _in(_MASK + "(mask & 3) = 3 AND (mask & 4) = 0")),
    "color_mask_or": ((("color", "0x6"),), ("color_labels",), _in(_MASK + "(mask & 6) <> 0")),
    "color_mask_or_not": ((("color", "0x8001"),), ("color_labels",), "(" + _in(_MASK + "(mask & 1) <> 0") + " OR " + _in(_MASK + "(mask & 8) = 8", no=True) + ")"),
    "history_basic": ((("history", "basic"),), ("history_hash",), _in(f"SELECT imgid FROM history_hash WHERE {_ALTERED}", no=True)),
    "history_auto": ((("history", "auto applied"),), ("history_hash",), _in("SELECT imgid FROM history_hash WHERE current_hash = auto_hash")),
    "history_altered": ((("history", "altered"),), ("history_hash",), _in(f"SELECT imgid FROM history_hash WHERE {_ALTERED} AND (auto_hash IS NULL OR current_hash <> auto_hash)")),
    "geo_not_tagged": ((("geotagging", "not tagged"),), (), "NOT (longitude IS NOT NULL AND latitude IS NOT NULL)"),
    "geo_any": ((("geotagging", "tagged*"),), (), "longitude IS NOT NULL AND latitude IS NOT NULL"),
    "geo_no_location": ((("geotagging", "tagged"),), ("tags", "tagged_images"), "longitude IS NOT NULL AND latitude IS NOT NULL AND " + _in(_TAGGED + "t.name ILIKE 'internal|locations%'", no=True)),
    "local_copy": ((("local_copy", "copied locally"),), (), "(flags & 2048) <> 0"),
    "aspect_ratio": ((("aspect_ratio", "1.33"),), (), "round(aspect_ratio, 2) = 1.33"),
    "aspect_range": ((("aspect_ratio", "[1.1;1.6]"),), (), "aspect_ratio BETWEEN 1.1 AND 1.6"),
    "camera": ((("camera", "orion m1"),), ("cameras",), _in("SELECT id FROM cameras WHERE concat_ws(' ', maker, model) ILIKE '%orion m1%'", "camera_id")),
    "camera_unnamed": ((("camera", 'unnamed,"Nova'),), ("cameras",), "(" + _in("SELECT id FROM cameras WHERE trim(concat_ws(' ', maker, model)) = '' OR concat_ws(' ', maker, model) ILIKE 'Nova%'", "camera_id") + " OR camera_id IS NULL)"),
    "tag_exact": ((("tag", "places|city4"),), ("tags", "tagged_images"), _in(_TAGGED + "t.name ILIKE 'places|city4'")),
    "tag_tree": ((("tag", "Brand#12*"),), ("tags", "tagged_images"), _in(_TAGGED + "(t.name ILIKE 'brand#12' OR t.name ILIKE 'brand#12|%')")),
    "tag_not_tagged": ((("tag", "not tagged"),), ("tags", "tagged_images"), _in(_TAGGED + "t.name NOT LIKE 'internal|%'", no=True)),
    "lens": ((("lens", 'prime 35,"n/a"'),), ("lens",), _in(_LENS + "name ILIKE '%prime 35%' OR name = 'n/a'", "lens_id")),
    "lens_unnamed": ((("lens", "unnamed"),), ("lens",), "(" + _in(_LENS + "coalesce(trim(name), '') = ''", "lens_id") + " OR lens_id IS NULL)"),
    "white_balance": ((("whitebalance", "daylight"),), ("whitebalance",), _in("SELECT id FROM whitebalance WHERE name ILIKE '%daylight%'", "whitebalance_id")),
    "flash": ((("flash", "fired"),), ("flash",), _in("SELECT id FROM flash WHERE name ILIKE '%fired%'", "flash_id")),
    "exposure_program": ((("exposure_program", "aperture"),), ("exposure_program",), _in("SELECT id FROM exposure_program WHERE name ILIKE '%aperture%'", "exposure_program_id")),
    "metering_mode": ((("metering_mode", "spot,multi"),), ("metering_mode",), _in("SELECT id FROM metering_mode WHERE name ILIKE '%spot%' OR name ILIKE '%multi%'", "metering_mode_id")),
    "group_id": ((("group_id", '"12'),), (), "CAST(group_id AS STRING) LIKE '12%'"),
    "focal_length": ((("focal_length", "50"),), (), "CAST(trunc(focal_length) AS INT) = 50"),
    "iso": ((("iso", ">= 400"),), (), "iso >= 400"),
    "iso_malformed": ((("iso", "many"),), (), "1 = 1"),
    "aperture": ((("aperture", "<2.9"),), (), "round(aperture, 1) < 2.9"),
    "exposure_fraction": ((("exposure", "[1/200;1/30]"),), (), "exposure >= 1.0/200 - 1e-5 AND exposure <= 1.0/30 + 1e-5"),
    "exposure_equal": ((("exposure", "1/126"),), (), "(CASE WHEN exposure < 0.4 THEN exposure ELSE round(exposure, 2) END) BETWEEN 1.0/126 - 1e-5 AND 1.0/126 + 1e-5"),
    "exposure_bias": ((("exposure_bias", "[-0.5;0.5]"),), (), "round(exposure_bias, 2) BETWEEN -0.5 AND 0.5"),
    "filename": ((("filename", "img_1,img_2/RAW"),), (), "(filename ILIKE '%img_1%' OR filename ILIKE '%img_2%') AND (flags & 64) <> 0"),
    "filename_extension": ((("filename", "/.jpg,HDR"),), (), "(filename ILIKE '%.jpg' OR (flags & 128) <> 0)"),
    "day": ((("day", "1996:03"),), (), f"datetime_taken BETWEEN {_us('1996-03-01')} AND {_us('1996-04-01')} - 1"),
    "day_not": ((("day", "<>1996"),), (), f"(datetime_taken < {_us('1996-01-01')} OR datetime_taken > {_us('1997-01-01')} - 1)"),
    "time_range": ((("time", "[1996:06:15;1997:02]"),), (), f"datetime_taken >= {_us('1996-06-15')} AND datetime_taken <= {_us('1997-03-01')} - 1"),
    "time_relative": ((("time", "[1996:06:15;+0000:02:10]"),), (), f"datetime_taken >= {_us('1996-06-15')} AND datetime_taken <= {_us('1996-08-25')}"),
    "change_timestamp": ((("change_timestamp", ">1997"),), (), f"change_timestamp > {_us('1998-01-01')} - 1"),
    "module": ((("module", "vel%"),), ("history",), _in("SELECT imgid FROM history WHERE enabled = 1 AND operation ILIKE 'vel%'")),
    "module_order": ((("order", "legacy"),), ("module_order",), _in("SELECT imgid FROM module_order WHERE version = 1")),
    "module_order_none": ((("order", "none"),), ("module_order",), _in("SELECT imgid FROM module_order", no=True)),
    "text_search": ((("textsearch", "syn3"),), ("tags", "tagged_images", "meta_data", "cameras", "film_rolls"), _in("SELECT imgid FROM meta_data WHERE value ILIKE '%syn3%' UNION " + _TAGGED + "t.name ILIKE '%syn3%' OR t.synonyms ILIKE '%syn3%' UNION SELECT i.id FROM images i JOIN cameras c ON c.id = i.camera_id WHERE i.filename ILIKE '%syn3%' OR c.maker ILIKE '%syn3%' OR c.model ILIKE '%syn3%' UNION SELECT i.id FROM images i JOIN film_rolls f ON f.id = i.film_id WHERE folder ILIKE '%syn3%'")),
    "rating_range": ((("rating", "[1;3]"),), (), f"{_STARS} BETWEEN 1 AND 3 AND NOT ({_REJECTED})"),
    "rating_range_rejected": ((("rating", "[-1;2]"),), (), f"{_STARS} <= 2"),
    "rating_range_of_rejected": ((("rating", "[-1;-1]"), ("iso", "400", "OR")), (), f"({_STARS} >= -1 AND {_STARS} <= -1 OR iso = 400)"),
    "rating_rejected": ((("rating", "-1"),), (), _REJECTED),
    "rating_below": ((("rating", "<3"),), (), f"({_STARS} < 3 OR {_REJECTED})"),
    "rating_above": ((("rating", ">=4"),), (), f"{_STARS} >= 4 AND NOT ({_REJECTED})"),
    "metadata": ((("metadata:0", "high"),), ("meta_data",), _in("SELECT imgid FROM meta_data WHERE key = 0 AND value ILIKE '%high%'")),
    "metadata_not_defined": ((("metadata:2", "not defined"),), ("meta_data",), _in("SELECT imgid FROM meta_data WHERE key = 2", no=True)),
    "rules_and_or": ((("rating", ">=4"), ("color", "red", "OR"), ("iso", "400", "AND")), ("color_labels",), f"({_STARS} >= 4 AND NOT ({_REJECTED}) OR " + _in("SELECT imgid FROM color_labels WHERE color = 0") + " AND iso = 400)"),
    "rules_empty": ((("rating", ">=4"), ("color", ""), ("filmroll", "", "AND NOT"), ("textsearch", "")), (), f"{_STARS} >= 4 AND NOT ({_REJECTED})"),
    "rules_empty_or": ((("rating", ">=4"), ("color", "", "OR")), (), f"({_STARS} >= 4 AND NOT ({_REJECTED}) OR 1 = 1)"),
    "rules_first_not": ((("iso", ">=400", "AND NOT"), ("rating", ">=1")), (), f"1 = 1 AND NOT (iso >= 400) AND {_STARS} >= 1 AND NOT ({_REJECTED})"),
    "rules_and_not": ((("iso", "<1000"), ("tag", "Brand#1%", "AND NOT"), ("flash", "fired", "AND NOT")), ("tags", "tagged_images", "flash"), "iso < 1000 AND NOT " + _in(_TAGGED + "t.name ILIKE 'brand#1%'") + " AND NOT " + _in("SELECT id FROM flash WHERE name ILIKE '%fired%'", "flash_id")),
}


def _rules(pairs) -> tuple[Rule, ...]:
    return tuple(Rule(*p) for p in pairs)


def _predicate_query(pairs):
    def run(spark, folder):
        return Collection(rules=_rules(pairs)).where(catalog(spark, folder)).select("id", "film_id", "flags")

    return run


QUERIES, ORACLE_SQL = {}, {}
for _name, (_pairs, _tables, _sql) in PREDICATES.items():
    QUERIES[f"rule_{_name}"] = _predicate_query(_pairs)
    ORACLE_SQL[f"rule_{_name}"] = oracle("images", *_tables) + f"SELECT id, film_id, flags FROM images WHERE (flags & 256) = 0 AND ({_sql})"

FLAGSHIP = Collection(rules=(Rule("rating", "[1;5]"), Rule("day", "[1996;1997]")), filters=(Rule("iso", ">100"),), sorts=(Sort("datetime", True),), limit=500)
_FLAGSHIP_WHERE = f"(flags & 256) = 0 AND {_STARS} BETWEEN 1 AND 5 AND NOT ({_REJECTED}) AND datetime_taken >= {_us('1996-01-01')} AND datetime_taken <= {_us('1998-01-01')} - 1 AND iso > 100"


def catalog_rules(spark, folder):
    """Rules, filters, an order with its tie-breaks, and a page."""
    return FLAGSHIP.query(catalog(spark, folder)).select("id", "filename", "datetime_taken", "flags")


def collection_grouped(spark, folder):
    return Collection(rules=(Rule("rating", ">=0"),), grouped=True).where(catalog(spark, folder)).select("id", "group_id")


def collection_film_roll(spark, folder):
    return Collection(film_id=7).where(catalog(spark, folder)).select("id", "film_id")


def collection_count(spark, folder):
    from pyspark.sql import functions as F

    return Collection(rules=(Rule("iso", "400"),)).where(catalog(spark, folder)).agg(F.countDistinct("id").alias("n"))


QUERIES |= {f.__name__: f for f in (catalog_rules, collection_grouped, collection_film_roll, collection_count)}
ORACLE_SQL |= {
    "catalog_rules": oracle("images") + f"SELECT id, filename, datetime_taken, flags FROM images WHERE {_FLAGSHIP_WHERE} ORDER BY datetime_taken DESC NULLS LAST, filename DESC NULLS LAST, version, id LIMIT 500",
    "collection_grouped": oracle("images") + f"SELECT id, group_id FROM (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY abs(id - group_id) * 2 + CASE WHEN id < group_id THEN 1 ELSE 0 END, id) AS n FROM images WHERE (flags & 256) = 0 AND NOT ({_REJECTED})) WHERE n = 1",
    "collection_film_roll": oracle("images") + "SELECT id, film_id FROM images WHERE (flags & 256) = 0 AND film_id = 7",
    "collection_count": oracle("images") + "SELECT count(DISTINCT id) AS n FROM images WHERE (flags & 256) = 0 AND iso = 400",
}

#: key -> (extra joins, order in SQL for the plain direction, for the turned one)
_SORTS = {
    "filename": ("", "filename ASC NULLS FIRST", "filename DESC NULLS LAST"),
    "datetime": ("", "datetime_taken ASC NULLS FIRST, filename", "datetime_taken DESC NULLS LAST, filename DESC"),
    "import_timestamp": ("", "import_timestamp ASC NULLS FIRST, filename", "import_timestamp DESC NULLS LAST, filename DESC"),
    "change_timestamp": ("", "change_timestamp ASC NULLS FIRST, filename", "change_timestamp DESC NULLS LAST, filename DESC"),
    "export_timestamp": ("", "export_timestamp ASC NULLS FIRST, filename", "export_timestamp DESC NULLS LAST, filename DESC"),
    "print_timestamp": ("", "print_timestamp ASC NULLS FIRST, filename", "print_timestamp DESC NULLS LAST, filename DESC"),
    "rating": ("", "CASE WHEN (flags & 8) <> 0 THEN -1 ELSE flags & 7 END, filename", "CASE WHEN (flags & 8) <> 0 THEN -1 ELSE flags & 7 END DESC, filename DESC"),
    "id": ("", "id, filename", "id DESC, filename DESC"),
    "color": ("LEFT JOIN (SELECT imgid, max(color) AS c FROM color_labels GROUP BY imgid) l ON l.imgid = id", "c DESC NULLS LAST, filename", "c ASC NULLS FIRST, filename DESC"),
    "group": ("", "group_id, CASE WHEN id <> group_id THEN 1 ELSE 0 END, id, filename", "group_id DESC, CASE WHEN id <> group_id THEN 1 ELSE 0 END, id, filename DESC"),
    "path": ("JOIN (SELECT id AS f, folder FROM film_rolls) r ON r.f = film_id", "folder, filename", "folder DESC, filename DESC"),
    "custom": ("", "position, filename", "position DESC, filename DESC"),
    "title": ("LEFT JOIN (SELECT imgid, min(value) AS v FROM meta_data WHERE key = 0 GROUP BY imgid) m ON m.imgid = id", "v ASC NULLS FIRST, filename", "v DESC NULLS LAST, filename DESC"),
    "description": ("LEFT JOIN (SELECT imgid, min(value) AS v FROM meta_data WHERE key = 1 GROUP BY imgid) m ON m.imgid = id", "v ASC NULLS FIRST, filename", "v DESC NULLS LAST, filename DESC"),
    "aspect_ratio": ("", "aspect_ratio, filename", "aspect_ratio DESC, filename DESC"),
}


def _sort_query(key: str, down: bool):
    def run(spark, folder):
        return Collection(sorts=(Sort(key, down),), limit=200, offset=40 if down else 0).query(catalog(spark, folder)).select("id")

    return run


def _order_query(key: str, down: bool):
    """The whole order that ``sort_*`` shows a page of."""

    def run(spark, folder):
        return Collection(sorts=(Sort(key, down),)).ranked(catalog(spark, folder)).select("id", "place")

    return run


for _key, (_join, _up, _down) in _SORTS.items():
    for _turned in (False, True):
        _n = f"sort_{_key}{'_desc' * _turned}"
        QUERIES[_n] = _sort_query(_key, _turned)
        ORACLE_SQL[_n] = oracle("images", *([t for t in ("color_labels", "film_rolls", "meta_data") if t in _join])) + f"SELECT id FROM images {_join} WHERE (flags & 256) = 0 ORDER BY {_down if _turned else _up}, version, id LIMIT 200 OFFSET {40 if _turned else 0}"
        _n = f"order_{_key}{'_desc' * _turned}"
        QUERIES[_n] = _order_query(_key, _turned)
        ORACLE_SQL[_n] = oracle("images", *([t for t in ("color_labels", "film_rolls", "meta_data") if t in _join])) + f"SELECT id, row_number() OVER (ORDER BY {_down if _turned else _up}, version, id) AS place FROM images {_join} WHERE (flags & 256) = 0"

#: Several keys in one order: (sorts, joins, order in SQL).
_MULTI = {
    "rating_datetime": ((Sort("rating", True), Sort("datetime")), "", "CASE WHEN (flags & 8) <> 0 THEN -1 ELSE flags & 7 END DESC, datetime_taken ASC NULLS FIRST, filename DESC"),
    "color_aspect_id": ((Sort("color"), Sort("aspect_ratio", True), Sort("id", True)), _SORTS["color"][0], "c DESC NULLS LAST, aspect_ratio DESC, id DESC, filename"),
    "title_filename_group": ((Sort("title"), Sort("filename", True), Sort("group")), _SORTS["title"][0], "v ASC NULLS FIRST, filename DESC, group_id, CASE WHEN id <> group_id THEN 1 ELSE 0 END, id"),
}


def _multi_query(sorts):
    def run(spark, folder):
        return Collection(sorts=sorts).ranked(catalog(spark, folder)).select("id", "place")

    return run


def order_shuffle(spark, folder):
    """A random order that the seed fixes; no SQL, since it rests on Spark's hash."""
    return Collection(sorts=(Sort("shuffle"),), seed=3).ranked(catalog(spark, folder)).select("id", "place")


QUERIES["order_shuffle"] = order_shuffle
for _key, (_sorts, _join, _order) in _MULTI.items():
    QUERIES[f"order_{_key}"] = _multi_query(_sorts)
    ORACLE_SQL[f"order_{_key}"] = oracle("images", *([t for t in ("color_labels", "meta_data") if t in _join])) + f"SELECT id, row_number() OVER (ORDER BY {_order}, version, id) AS place FROM images {_join} WHERE (flags & 256) = 0"
