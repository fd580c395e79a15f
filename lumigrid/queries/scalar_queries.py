"""Queries for templates, formulas, time and streaming-style windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calculator import compile_formula
from ..functions.template import compile_template, image_variables
from ..plans.roles import catalog, oracle

_T = "(TIMESTAMP '1970-01-01' + to_microseconds(datetime_taken - 62135596800000000))"
_STEM = "regexp_replace(filename, '\\.[^.]*$', '')"
_EXT = "regexp_extract(filename, '\\.([^.]*)$', 1)"
TEMPLATES = {
    "date_path": ("$(YEAR)/$(MONTH)/$(DAY)_$(FILE.NAME).$(FILE.EXTENSION)", f"concat(strftime({_T}, '%Y/%m/%d'), '_', {_STEM}, '.', {_EXT})"),
    "substring": ("$(FILE.NAME:4)-$(FILE.NAME:0:3)-$(FILE.NAME:-2)", f"concat(substr({_STEM}, 5), '-', substr({_STEM}, 1, 3), '-', CASE WHEN length({_STEM}) < 2 THEN {_STEM} ELSE right({_STEM}, 2) END)"),
    "case": ("$(FILE.EXTENSION^^)$(FILE.EXTENSION,,)$(FILE.NAME^)", f"concat(upper({_EXT}), lower({_EXT}), upper({_STEM}[1]), substr({_STEM}, 2))"),
    "replace": ("$(FILE.NAME/img/pic)$(FILE.NAME//1/one)$(FILE.NAME/#img_/x)$(FILE.NAME/%9/nine)", f"concat(regexp_replace({_STEM}, 'img', 'pic'), replace({_STEM}, '1', 'one'), CASE WHEN starts_with({_STEM}, 'img_') THEN concat('x', substr({_STEM}, 5)) ELSE {_STEM} END, CASE WHEN ends_with({_STEM}, '9') THEN concat(left({_STEM}, -1), 'nine') ELSE {_STEM} END)"),
    "strip": ("$(FILE.NAME#img_).$(FILE.NAME%7)", f"concat(CASE WHEN starts_with({_STEM}, 'img_') THEN substr({_STEM}, 5) ELSE {_STEM} END, '.', CASE WHEN ends_with({_STEM}, '7') THEN left({_STEM}, -1) ELSE {_STEM} END)"),
    "default": ("$(NOTHING-none)|$(ID+set)|$(NOTHING-$(ID))|$(LONGITUDE-unplaced)", "concat('none|set|', CAST(id AS STRING), '|', CASE WHEN longitude IS NULL THEN 'unplaced' ELSE CAST(round(longitude, 6) AS STRING) END)"),
    "rating": ("$(RATING)$(STARS)-$(EXIF.ISO)-$(EXIF.FOCAL.LENGTH)", "concat(CASE WHEN (flags & 8) <> 0 THEN '-1' ELSE CAST(flags & 7 AS STRING) END, repeat('*', flags & 7), '-', CAST(CAST(trunc(iso) AS INT) AS STRING), '-', CAST(CAST(trunc(focal_length) AS INT) AS STRING))"),
}
QUERIES, ORACLE_SQL = {}, {}


def _template(text):
    def run(spark, folder):
        return catalog(spark, folder)["images"].select("id", compile_template(text, image_variables()).alias("value"))

    return run


for _n, (_text, _sql) in TEMPLATES.items():
    QUERIES[f"template_{_n}"] = _template(_text)
    ORACLE_SQL[f"template_{_n}"] = oracle("images") + f"SELECT id, {_sql} AS value FROM images"

_FORMULAS = {"plain": ("2 * x + 3 - x / 4", "2 * focal_length + 3 - focal_length / 4"), "power": ("2 ^ 3 ^ 2 + x % 7", "power(power(2, 3), 2) + focal_length % 7"), "ratio": ("x : 50", "greatest(focal_length, 50) / least(focal_length, 50)"), "signs": ("-(x - 100) * +2", "-(focal_length - 100) * 2")}


def _formula(text):
    def run(spark, folder):
        return catalog(spark, folder)["images"].select("id", F.round(compile_formula(text, F.col("focal_length")), 9).alias("value"))

    return run


for _n, (_text, _sql) in _FORMULAS.items():
    QUERIES[f"formula_{_n}"] = _formula(_text)
    ORACLE_SQL[f"formula_{_n}"] = oracle("images") + f"SELECT id, round(CAST({_sql} AS DOUBLE), 9) AS value FROM images"


def event_windows(spark, folder):
    """Tumbling windows over the event stream's table, as the streaming job computes them."""
    from ..streaming.windows import tumbling

    return tumbling(spark.read.parquet(f"{folder}/events.parquet"), "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, folder):
    from ..streaming.windows import sessions

    return sessions(spark.read.parquet(f"{folder}/events.parquet"), 1800).select("user_id", "start", "stop", "n")


def text_like(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").where(F.col("text").ilike("%license%")).select("doc_id", F.lower("source").alias("source"))


def text_regexp(spark, folder):
    """Names by a regular expression, case told apart."""
    return catalog(spark, folder)["images"].where(F.col("filename").rlike(r"^img_[0-9]*[05]\.(CR2|jpe?g)$")).select("id", "filename")


def text_collation(spark, folder):
    """Names that are equal but for case, and their order, by Unicode's rules."""
    rolls = catalog(spark, folder)["film_rolls"]
    name = F.collate("folder", "UNICODE_CI")
    return rolls.where((name == "/PHOTOS/asia/nation_2") | name.startswith(F.collate(F.lit("/Photos/Africa"), "UNICODE_CI"))).select("id", F.col("folder").alias("folder"))


QUERIES |= {f.__name__: f for f in (event_windows, event_sessions, text_like, text_regexp, text_collation)}
ORACLE_SQL |= {
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    "text_regexp": oracle("images") + r"SELECT id, filename FROM images WHERE regexp_matches(filename, '^img_[0-9]*[05]\.(CR2|jpe?g)$')",
    "text_collation": oracle("film_rolls") + "SELECT id, folder FROM film_rolls WHERE lower(folder) = '/photos/asia/nation_2' OR lower(folder) LIKE '/photos/africa%'",
    "text_like": "SELECT doc_id, lower(source) AS source FROM documents WHERE text ILIKE '%license%'",
}
