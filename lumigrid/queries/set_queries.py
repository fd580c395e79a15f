"""Queries for selections, groups, ratings, history, order and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, sets
from ..plans.collection import Collection, Rule
from ..plans.roles import catalog, oracle

QUERIES, ORACLE_SQL = {}, {}


def _add(name, tables, sql, make):
    QUERIES[name] = lambda spark, folder: make(catalog(spark, folder))
    if sql:
        ORACLE_SQL[name] = oracle(*tables) + sql


_ISO = Collection(rules=(Rule("iso", "400"),))
_SOME = "(SELECT id FROM images WHERE (flags & 256) = 0 AND iso = 400)"
_S = "selected_images"
some = lambda c: sets.ids(_ISO.where(c))
_add("select_add", ("images", _S), f"SELECT imgid FROM selected_images UNION SELECT id FROM {_SOME}", lambda c: sets.select_add(c[_S], some(c)))
_add("select_remove", ("images", _S), f"SELECT imgid FROM selected_images WHERE imgid NOT IN {_SOME}", lambda c: sets.select_remove(c[_S], some(c)))
_add("select_toggle", ("images", _S), f"(SELECT imgid FROM selected_images EXCEPT SELECT id FROM {_SOME}) UNION (SELECT id FROM {_SOME} EXCEPT SELECT imgid FROM selected_images)", lambda c: sets.select_toggle(c[_S], some(c)))
_add("select_invert", ("images", _S), f"SELECT id AS imgid FROM {_SOME} WHERE id NOT IN (SELECT imgid FROM selected_images)", lambda c: sets.select_invert(c[_S], _ISO.where(c)))
_add("select_prune", ("images", _S), f"SELECT imgid FROM selected_images WHERE imgid IN {_SOME}", lambda c: sets.select_prune(c[_S], _ISO.where(c)))
_add("select_film_rolls", ("images", _S), "SELECT id AS imgid FROM images WHERE film_id IN (SELECT film_id FROM images JOIN selected_images ON imgid = id)", lambda c: sets.select_film_rolls(c[_S], c["images"]))
_add("select_unaltered", ("images", "history"), "SELECT id AS imgid FROM images WHERE id NOT IN (SELECT imgid FROM history)", lambda c: sets.select_unaltered(c["images"], c["history"]))
_add("select_range", ("images",), "SELECT id AS imgid FROM (SELECT id, row_number() OVER (ORDER BY filename, id) AS r FROM images) WHERE r BETWEEN (SELECT least(a, b) FROM (SELECT max(CASE WHEN id = 5 THEN r END) AS a, max(CASE WHEN id = 77 THEN r END) AS b FROM (SELECT id, row_number() OVER (ORDER BY filename, id) AS r FROM images))) AND (SELECT greatest(a, b) FROM (SELECT max(CASE WHEN id = 5 THEN r END) AS a, max(CASE WHEN id = 77 THEN r END) AS b FROM (SELECT id, row_number() OVER (ORDER BY filename, id) AS r FROM images)))", lambda c: sets.select_range(sets.numbered(c["images"].select("id", "filename"), [F.col("filename"), F.col("id")]), 5, 77))
_add("act_on", ("images", _S), "SELECT id AS imgid FROM images WHERE group_id IN (SELECT group_id FROM images WHERE id IN (SELECT imgid FROM selected_images))", lambda c: sets.act_on(c[_S].where("imgid = 8"), c[_S], c["images"]))
_add("group_join", ("images", _S), "SELECT id, CASE WHEN id IN (SELECT imgid FROM selected_images) THEN 9 ELSE group_id END AS group_id FROM images", lambda c: sets.regroup(c["images"], c[_S], 9).select("id", "group_id"))
_add("group_leave", ("images", _S), "SELECT i.id, CASE WHEN s.imgid IS NOT NULL THEN i.id WHEN g.led = 0 THEN g.least ELSE i.group_id END AS group_id FROM images i LEFT JOIN selected_images s ON s.imgid = i.id LEFT JOIN (SELECT group_id, min(id) AS least, max(CASE WHEN id = group_id THEN 1 ELSE 0 END) AS led FROM images WHERE id NOT IN (SELECT imgid FROM selected_images) GROUP BY 1) g ON g.group_id = i.group_id", lambda c: sets.ungroup(c["images"], c[_S]).select("id", "group_id"))
_add("group_lead", ("images",), "SELECT id, CASE WHEN group_id = 8 THEN 10 ELSE group_id END AS group_id FROM images", lambda c: sets.lead_group(c["images"], 10).select("id", "group_id"))
_add("rate_three", ("images", _S), "SELECT id, CAST(CASE WHEN id IN (SELECT imgid FROM selected_images) THEN (flags & ~15) | 3 ELSE flags END AS INT) AS flags FROM images", lambda c: sets.rate(c["images"], c[_S], 3).select("id", "flags"))
_add("rate_reject", ("images", _S), "SELECT id, CAST(CASE WHEN id IN (SELECT imgid FROM selected_images) THEN flags | 8 ELSE flags END AS INT) AS flags FROM images", lambda c: sets.rate(c["images"], c[_S], -1).select("id", "flags"))
_add("rate_toggle", ("images",), "SELECT id, CAST(CASE WHEN (flags & 15) = 1 THEN flags & ~15 ELSE flags END AS INT) AS flags FROM images", lambda c: sets.rate(c["images"], sets.ids(c["images"].where("(flags & 15) = 1")), 1).select("id", "flags"))
_add("rate_up", ("images", _S), "SELECT id, CAST(CASE WHEN id IN (SELECT imgid FROM selected_images) AND (flags & 8) = 0 THEN (flags & ~7) | least((flags & 7) + 1, 5) ELSE flags END AS INT) AS flags FROM images", lambda c: sets.step_rating(c["images"], c[_S], 1).select("id", "flags"))
_add("label_toggle", ("color_labels", _S), "SELECT imgid, color FROM color_labels WHERE NOT (color = 1 AND imgid IN (SELECT imgid FROM selected_images)) UNION ALL SELECT imgid, 1 FROM selected_images WHERE EXISTS (SELECT 1 FROM selected_images s WHERE s.imgid NOT IN (SELECT imgid FROM color_labels WHERE color = 1))", lambda c: sets.toggle_label(c["color_labels"], c[_S], 1))
_add("tag_attach", ("tagged_images", _S), "SELECT imgid, tagid FROM tagged_images UNION SELECT imgid, t FROM selected_images, (SELECT 3 AS t UNION SELECT 4)", lambda c: sets.attach(c["tagged_images"], c[_S], [3, 4]))
_add("tag_detach", ("tagged_images", _S), "SELECT imgid, tagid FROM tagged_images WHERE NOT (tagid = 3 AND imgid IN (SELECT imgid FROM selected_images))", lambda c: sets.detach(c["tagged_images"], c[_S], 3))
_add("tag_rename", ("tags",), "SELECT id, CASE WHEN name = 'Brand#1' THEN 'Make' WHEN name LIKE 'Brand#1|%' THEN concat('Make', substr(name, 8)) ELSE name END AS name FROM tags", lambda c: sets.rename_tag(c["tags"], "Brand#1", "Make").select("id", "name"))
_add("metadata_set", ("meta_data", _S), "SELECT imgid, key, value FROM meta_data WHERE NOT (key = 1 AND imgid IN (SELECT imgid FROM selected_images)) UNION ALL SELECT imgid, 1, 'new' FROM selected_images", lambda c: sets.set_metadata(c["meta_data"], c[_S], 1, "new"))
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imgid, operation, multi_priority ORDER BY num DESC, params DESC) AS r FROM history) WHERE r = 1)"
_H = "SELECT imgid, num, operation, enabled, multi_priority, params FROM "


def _clean(c):
    """One entry per image and number."""
    h = c["history"]
    return h.groupBy("imgid", "num").agg(F.max(F.struct("operation", "enabled", "multi_priority", "params")).alias("r")).select("imgid", "num", "r.*")


_CLEAN = "hist AS (SELECT imgid, num, r.operation AS operation, r.enabled AS enabled, r.multi_priority AS multi_priority, r.params AS params FROM (SELECT imgid, num, max({'operation': operation, 'enabled': enabled, 'multi_priority': multi_priority, 'params': params}) AS r FROM history GROUP BY 1, 2))"
_LAST = _LATEST.replace("FROM history", "FROM hist")


def _history(name, sql, make, *tables):
    QUERIES[name] = lambda spark, folder: make(catalog(spark, folder))
    ORACLE_SQL[name] = oracle("history", *tables).rstrip() + ", " + _CLEAN + " " + sql


_COLS = ["imgid", "num", "operation", "enabled", "multi_priority", "params"]
_history("history_latest", _H + _LAST, lambda c: sets.latest(_clean(c)).select(_COLS))
_history("history_compress", f"SELECT imgid, CAST(row_number() OVER (PARTITION BY imgid ORDER BY num, operation, multi_priority) - 1 AS INT) AS num, operation, enabled, multi_priority, params FROM {_LAST}", lambda c: sets.compress(_clean(c)).select(_COLS))
_history("history_truncate", "SELECT imgid, num, operation, enabled, multi_priority, params FROM hist WHERE num < imgid % 5 + 1", lambda c: sets.truncate(_clean(c), c["images"].select(F.col("id").alias("imgid"), (F.col("id") % 5 + 1).alias("history_end"))).select(_COLS), "images")
_history("history_copy", f"SELECT imgid, num, operation, enabled, multi_priority, params FROM hist WHERE imgid = 1 OR imgid NOT IN (SELECT imgid FROM selected_images) UNION ALL SELECT s.imgid, num, operation, enabled, multi_priority, params FROM {_LAST} l, selected_images s WHERE l.imgid = 1 AND s.imgid <> 1", lambda c: sets.copy_history(_clean(c), 1, c[_S], merge=False).select(_COLS), _S)
_history("history_merge", f"SELECT imgid, num, operation, enabled, multi_priority, params FROM hist h WHERE imgid = 1 OR imgid NOT IN (SELECT imgid FROM selected_images) OR NOT EXISTS (SELECT 1 FROM hist x WHERE x.imgid = 1 AND x.operation = h.operation AND x.multi_priority = h.multi_priority) UNION ALL SELECT s.imgid, CAST(num + coalesce((SELECT max(num) + 1 FROM hist y WHERE y.imgid = s.imgid), 0) AS INT), operation, enabled, multi_priority, params FROM {_LAST} l, selected_images s WHERE l.imgid = 1 AND s.imgid <> 1", lambda c: sets.copy_history(_clean(c), 1, c[_S], merge=True).select(_COLS), _S)
_history("style_apply", "SELECT imgid, num, operation, enabled, multi_priority, params FROM hist h WHERE imgid NOT IN (SELECT imgid FROM selected_images) OR NOT (operation IN ('exposure', 'crop') AND multi_priority = 0) UNION ALL SELECT imgid, CAST(n + coalesce((SELECT max(num) + 1 FROM hist y WHERE y.imgid = s.imgid), 0) AS INT), op, 1, 0, 'style' FROM selected_images s, (SELECT 0 AS n, 'exposure' AS op UNION ALL SELECT 1, 'crop')", lambda c: sets.apply_style(_clean(c).select(_COLS), c["images"].sparkSession.createDataFrame([(0, "exposure", 1, 0, "style"), (1, "crop", 1, 0, "style")], "num int, operation string, enabled int, multi_priority int, params string"), c[_S]), _S)
_history("style_candidates", f"SELECT operation, multi_priority, params, 'history' AS origin FROM {_LAST} WHERE imgid = 1 AND NOT (operation = 'exposure' AND multi_priority = 0) UNION ALL SELECT 'exposure', 0, 'style', 'style'", lambda c: sets.style_candidates(c["images"].sparkSession.createDataFrame([("exposure", 0, "style")], "operation string, multi_priority int, params string"), _clean(c), 1))
_add("hash_upsert", ("history_hash", _S), "SELECT coalesce(h.imgid, s.imgid) AS imgid, basic_hash, auto_hash, CASE WHEN s.imgid IS NOT NULL THEN 'new' ELSE current_hash END AS current_hash FROM history_hash h FULL JOIN selected_images s ON s.imgid = h.imgid", lambda c: sets.upsert(c["history_hash"], c[_S].withColumn("current_hash", F.lit("new")), "imgid"))
_add("duplicate_images", ("images", _S), "SELECT id, filename, version FROM images UNION ALL SELECT id + (SELECT max(id) FROM images), filename, CAST((SELECT max(version) FROM images x WHERE x.film_id = i.film_id AND x.filename = i.filename) + row_number() OVER (PARTITION BY film_id, filename ORDER BY id) AS INT) FROM images i WHERE id IN (SELECT imgid FROM selected_images)", lambda c: sets.duplicate(c["images"], c[_S]).select("id", "filename", "version"))
_add("import_dedupe", ("images",), "SELECT id + 1 AS id FROM images WHERE concat_ws('-', filename, CAST(datetime_taken + (id % 3) AS STRING)) NOT IN (SELECT concat_ws('-', filename, CAST(datetime_taken AS STRING)) FROM images)", lambda c: sets.not_imported(c["images"].select((F.col("id") + 1).alias("id"), "filename", (F.col("datetime_taken") + F.col("id") % 3).alias("datetime_taken")), c["images"]).select("id"))
_order = lambda: [F.col("filename"), F.col("id")]
_NUM = "(SELECT id, row_number() OVER (ORDER BY filename, id) AS rowid FROM images)"
_num = lambda c: sets.numbered(c["images"].select("id", "filename"), _order()).select("id", "rowid")
_add("window_rowid", ("images",), f"SELECT id, rowid FROM {_NUM}", _num)
_add("window_positions", ("images",), f"SELECT id, rowid * 4294967296 AS position FROM {_NUM}", lambda c: sets.positions(c["images"].select("id", "filename"), _order()).select("id", "position"))
_add("window_circular", ("images",), f"SELECT id, CASE WHEN rowid >= 40 THEN rowid - 39 ELSE rowid + 1000 - 39 END AS newrow FROM {_NUM}", lambda c: sets.circular(_num(c), 40, 1000).select("id", "newrow"))
_add("page_keyset", ("images",), f"SELECT id, rowid FROM {_NUM} WHERE rowid > 100 ORDER BY rowid LIMIT 25", lambda c: sets.page_after(_num(c), 100, 25))
_add("page_keyset_back", ("images",), f"SELECT id, rowid FROM {_NUM} WHERE rowid < 100 ORDER BY rowid DESC LIMIT 25", lambda c: sets.page_after(_num(c), 100, 25, True))
_add("first_after", ("images", _S), f"SELECT coalesce(min(CASE WHEN rowid > b THEN rowid END), max(CASE WHEN rowid < a THEN rowid END)) AS rowid FROM {_NUM} n, (SELECT min(rowid) AS a, max(rowid) AS b FROM {_NUM} JOIN selected_images ON imgid = id) WHERE n.id NOT IN (SELECT imgid FROM selected_images)", lambda c: sets.next_outside(_num(c), c[_S]))
_add("reorder_before", ("images",), "SELECT id, CASE WHEN id IN (20, 30) THEN (SELECT max(position) FROM images WHERE id < 10) + (10 * 4294967296 - (SELECT max(position) FROM images WHERE id < 10)) // 3 * CASE id WHEN 20 THEN 1 ELSE 2 END ELSE position END AS position FROM images", lambda c: sets.move_before(c["images"], c["images"].where("id in (20, 30)").select(F.col("id").alias("imgid")), 10).select("id", "position"))
_add("grid_clusters", (), None, lambda c: cluster.grid_dbscan(c["images"].select("id", "longitude", "latitude"), 1.5, 3).select("id", "cluster"))

# --- tags and styles as tables that grow and shrink
_FRESH = "SELECT DISTINCT concat('Film|', CAST(film_id AS STRING)) AS name FROM images UNION SELECT name FROM tags"
_add("tag_create", ("images", "tags"), f"SELECT id, name FROM tags UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name) AS id, name FROM ({_FRESH}) WHERE name NOT IN (SELECT name FROM tags)", lambda c: sets.create_tags(c["tags"], c["images"].selectExpr("concat('Film|', CAST(film_id AS STRING)) AS name").union(c["tags"].select("name"))).select("id", "name"))
_add("tag_set", ("tags",), "SELECT id, CASE WHEN id IN (2, 5) THEN 'alias' ELSE synonyms END AS synonyms, CAST(CASE WHEN id IN (2, 5) THEN 3 ELSE flags END AS INT) AS flags FROM tags", lambda c: sets.set_tag(c["tags"], [2, 5], "alias", 3).select("id", "synonyms", "flags"))
_ITEMS = "SELECT concat('style ', CAST(imgid % 3 AS STRING)) AS name, num, operation, enabled, multi_priority, params FROM hist WHERE imgid IN (2, 3, 4)"
_FIELDS = ["name", "num", "operation", "enabled", "multi_priority", "params"]
_items = lambda c: _clean(c).where("imgid IN (2, 3, 4)").selectExpr("concat('style ', CAST(imgid % 3 AS STRING)) AS name", *_FIELDS[1:])
_OWN = f"(SELECT * FROM {_LAST} WHERE imgid = 1)"
_history("style_create", f"SELECT * FROM ({_ITEMS}) WHERE name <> 'style 1' UNION ALL SELECT 'style 1', CAST(row_number() OVER (ORDER BY num, operation, multi_priority) - 1 AS INT), operation, enabled, multi_priority, params FROM {_OWN} WHERE operation <> 'crop'", lambda c: sets.create_style(_items(c), _clean(c), 1, "style 1", ["exposure", "sharpen", "velvia", "flip", "temperature"]).select(_FIELDS))
_history("style_update", f"SELECT i.name, i.num, i.operation, CASE WHEN i.name = 'style 0' AND o.imgid IS NOT NULL THEN o.enabled ELSE i.enabled END AS enabled, i.multi_priority, CASE WHEN i.name = 'style 0' AND o.imgid IS NOT NULL THEN o.params ELSE i.params END AS params FROM ({_ITEMS}) i LEFT JOIN {_OWN} o ON o.operation = i.operation AND o.multi_priority = i.multi_priority WHERE NOT (i.name = 'style 0' AND i.operation = 'flip')", lambda c: sets.update_style(_items(c), _clean(c), 1, "style 0", ["flip"]).select(_FIELDS))
_history("style_delete", f"SELECT * FROM ({_ITEMS}) WHERE name <> 'style 2'", lambda c: sets.delete_styles(_items(c), ["style 2"]).select(_FIELDS))
