"""Selections, groups, ratings, labels, tags, metadata, history and styles as whole-table updates.

Every function takes frames and returns the changed frame; nothing is altered in place, so a
caller writes the result as the table's next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..plans.catalog import REJECTED, bits

# --- selections: frames of one column, imgid


def ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(F.col(column).alias("imgid")).distinct()


def select_add(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.select("imgid").union(more.select("imgid")).distinct()


def select_remove(selection: DataFrame, gone: DataFrame) -> DataFrame:
    return selection.select("imgid").join(gone.select("imgid"), "imgid", "left_anti")


def select_toggle(selection: DataFrame, some: DataFrame) -> DataFrame:
    """Symmetric difference."""
    return select_remove(selection, some).union(select_remove(some.distinct(), selection))


def select_invert(selection: DataFrame, collection: DataFrame) -> DataFrame:
    """Of the collection, what is not selected."""
    return select_remove(ids(collection), selection)


def select_prune(selection: DataFrame, collection: DataFrame) -> DataFrame:
    return selection.select("imgid").join(ids(collection), "imgid", "left_semi")


def select_range(numbered: DataFrame, first: int, last: int) -> DataFrame:
    """From one image to another in the collection's order (columns id, rowid), both included."""
    ends = numbered.where(F.col("id").isin(first, last)).agg(F.min("rowid").alias("a"), F.max("rowid").alias("b"))
    return numbered.join(F.broadcast(ends), F.col("rowid").between(F.col("a"), F.col("b"))).select(F.col("id").alias("imgid"))  # ends is one row


def select_film_rolls(selection: DataFrame, images: DataFrame) -> DataFrame:
    """All images of the film rolls of the selected ones."""
    rolls = images.join(selection, images.id == selection.imgid, "left_semi").select("film_id").distinct()
    return ids(images.join(rolls, "film_id", "left_semi"))


def select_unaltered(collection: DataFrame, history: DataFrame) -> DataFrame:
    return ids(collection.join(history.select("imgid"), collection.id == F.col("imgid"), "left_anti"))


def act_on(hovered: DataFrame, selection: DataFrame, images: DataFrame, whole_groups: bool = True) -> DataFrame:
    """The hovered image with the selection if it is in it, else alone; with its groups' members."""
    inside = hovered.join(selection, "imgid", "left_semi")
    base = selection.select("imgid").crossJoin(F.broadcast(inside.limit(1).select(F.lit(1).alias("_h")))).drop("_h").union(hovered).distinct()  # one row at most
    if not whole_groups:
        return base
    groups = images.join(base, images.id == base.imgid, "left_semi").select("group_id").distinct()
    return ids(images.join(groups, "group_id", "left_semi"))


# --- groups


def regroup(images: DataFrame, members: DataFrame, leader: int) -> DataFrame:
    """Members join the leader's group."""
    inside = members.select(F.col("imgid").alias("id")).distinct().withColumn("_m", F.lit(True))
    return images.join(inside, "id", "left").withColumn("group_id", F.when(F.col("_m"), F.lit(leader)).otherwise(F.col("group_id"))).select(*images.columns)


def ungroup(images: DataFrame, gone: DataFrame) -> DataFrame:
    """Images leave their groups for groups of their own; a group whose leader left is led by its smallest id."""
    out = images.join(gone.select(F.col("imgid").alias("id")).distinct().withColumn("_g", F.lit(True)), "id", "left")
    stay = out.where("_g is null").groupBy("group_id").agg(F.min("id").alias("_least"), F.max((F.col("id") == F.col("group_id")).cast("int")).alias("_led"))
    out = out.join(stay, "group_id", "left")
    new = F.when(F.col("_g"), F.col("id")).when(F.col("_led") == 0, F.col("_least")).otherwise(F.col("group_id"))
    return out.withColumn("group_id", new).select(*images.columns)


def lead_group(images: DataFrame, leader: int) -> DataFrame:
    """The image represents its group from now on."""
    own = images.where(F.col("id") == leader).select(F.col("group_id").alias("_old"))
    hit = images.join(F.broadcast(own), F.col("group_id") == F.col("_old"), "left")  # one row
    return hit.withColumn("group_id", F.when(F.col("_old").isNotNull(), F.lit(leader)).otherwise(F.col("group_id"))).select(*images.columns)


# --- ratings and labels


def rated(flags: Column, stars: int) -> Column:
    """Flags after a rating: -1 rejects and keeps the stars, 0 to 5 sets them and takes a rejection back."""
    if stars < 0:
        return flags.bitwiseOR(F.lit(REJECTED)).cast("int")
    return flags.bitwiseAND(F.lit(~(REJECTED | 7))).bitwiseOR(F.lit(min(stars, 5))).cast("int")


def rate(images: DataFrame, chosen: DataFrame, stars: int, toggle: bool = True) -> DataFrame:
    """Rate the chosen images. If all have the value already, one star goes to none and a rejection is taken back."""
    c = chosen.select(F.col("imgid").alias("id")).distinct().withColumn("_c", F.lit(True))
    out = images.join(c, "id", "left")
    flags = F.col("flags")
    have = (bits(flags, REJECTED) != 0) if stars < 0 else (bits(flags, 7) == stars) & (bits(flags, REJECTED) == 0)
    if toggle and stars in (-1, 1):
        every = out.where("_c").agg(F.min(have.cast("int")).alias("_all"))
        out = out.crossJoin(F.broadcast(every))  # one row
        back = flags.bitwiseAND(F.lit(~REJECTED)).cast("int") if stars < 0 else rated(flags, 0)
        new = F.when(F.col("_all") == 1, back).otherwise(rated(flags, stars))
    else:
        new = rated(flags, stars)
    return out.withColumn("flags", F.when(F.col("_c"), new).otherwise(flags)).select(*images.columns)


def step_rating(images: DataFrame, chosen: DataFrame, by: int) -> DataFrame:
    """Up or down within 0 to 5; a rejected image stays as it is."""
    c = chosen.select(F.col("imgid").alias("id")).distinct().withColumn("_c", F.lit(True))
    flags = F.col("flags")
    stars = F.least(F.greatest(bits(flags, 7) + by, F.lit(0)), F.lit(5))
    new = flags.bitwiseAND(F.lit(~7)).bitwiseOR(stars).cast("int")
    return images.join(c, "id", "left").withColumn("flags", F.when(F.col("_c") & (bits(flags, REJECTED) == 0), new).otherwise(flags)).select(*images.columns)


def toggle_label(labels: DataFrame, chosen: DataFrame, color: int) -> DataFrame:
    """If every chosen image has the label it goes from all, else all get it."""
    c = chosen.select("imgid").distinct()
    have = labels.where(F.col("color") == color).join(c, "imgid", "left_semi").select("imgid")
    lacking = c.join(have, "imgid", "left_anti")
    others = labels.join(c.withColumn("color", F.lit(color)), ["imgid", "color"], "left_anti")
    some_lack = lacking.limit(1).select(F.lit(1).alias("_x"))
    return others.unionByName(c.crossJoin(F.broadcast(some_lack)).select("imgid", F.lit(color).alias("color")))  # one row at most


# --- tags and metadata


def attach(links: DataFrame, chosen: DataFrame, tagids: list[int]) -> DataFrame:
    new = chosen.select("imgid").distinct().select("imgid", F.explode(F.array(*(F.lit(t).cast("long") for t in tagids))).alias("tagid"))
    return links.select("imgid", "tagid").union(new).distinct()


def detach(links: DataFrame, chosen: DataFrame, tagid: int) -> DataFrame:
    return links.join(chosen.select("imgid").distinct().withColumn("tagid", F.lit(tagid).cast("long")), ["imgid", "tagid"], "left_anti")


def create_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Names (a column ``name``) that no tag has yet become tags, with ids above the highest one in the order of the names."""
    fresh = names.select("name").where("name <> ''").distinct().join(tags.select("name"), "name", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = global_rank(fresh, [F.col("name")], "_n").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n"))  # one row
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in tags.dtypes if c not in ("id", "name")}
    return tags.unionByName(new.select(*(empty.get(c, F.col(c)) for c in tags.columns)))


def set_tag(tags: DataFrame, tagids: list[int], synonyms: str | None = None, flags: int | None = None) -> DataFrame:
    """Other synonyms or flags for some tags; what is not given stays."""
    chosen = F.col("id").isin(tagids)
    if synonyms is not None:
        tags = tags.withColumn("synonyms", F.when(chosen, F.lit(synonyms)).otherwise(F.col("synonyms")))
    return tags if flags is None else tags.withColumn("flags", F.when(chosen, F.lit(flags)).otherwise(F.col("flags")))


def rename_tag(tags: DataFrame, old: str, new: str) -> DataFrame:
    """A tag and everything below it."""
    n = F.col("name")
    renamed = F.when(n == old, F.lit(new)).when(n.startswith(old + "|"), F.concat(F.lit(new), F.substring(n, len(old) + 1, 1_000_000))).otherwise(n)
    return tags.withColumn("name", renamed)


def delete_tags(tags: DataFrame, links: DataFrame, gone: list[int]) -> tuple[DataFrame, DataFrame]:
    return tags.where(~F.col("id").isin(gone)), links.where(~F.col("tagid").isin(gone))


def set_metadata(meta: DataFrame, chosen: DataFrame, key: int, value: str | None) -> DataFrame:
    """One value for a key of the chosen images; null or empty clears it."""
    c = chosen.select("imgid").distinct()
    rest = meta.join(c.withColumn("key", F.lit(key)), ["imgid", "key"], "left_anti").select("imgid", "key", "value")
    return rest if not value else rest.unionByName(c.select("imgid", F.lit(key).alias("key"), F.lit(value).alias("value")))


# --- history


def latest(history: DataFrame) -> DataFrame:
    """Per image, operation and instance only the last entry."""
    return history.groupBy("imgid", "operation", "multi_priority").agg(F.max_by(F.struct(*(c for c in history.columns if c not in ("imgid", "operation", "multi_priority"))), "num").alias("_r")).select("imgid", "operation", "multi_priority", "_r.*").select(*history.columns)


def compress(history: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Latest entries below each image's history end (imgid, history_end), renumbered from 0."""
    if ends is not None:
        history = history.join(ends, "imgid").where("num < history_end").select(*history.columns)
    number = F.row_number().over(Window.partitionBy("imgid").orderBy("num", "operation", "multi_priority")) - 1
    return latest(history).withColumn("num", number.cast("int"))


def truncate(history: DataFrame, ends: DataFrame) -> DataFrame:
    return history.join(ends, "imgid").where("num < history_end").select(*history.columns)


def copy_history(history: DataFrame, source: int, targets: DataFrame, merge: bool = True) -> DataFrame:
    """The source's latest entries replace the targets' histories, or (``merge``) follow them where operations differ."""
    own = latest(history.where(F.col("imgid") == source))
    t = targets.select(F.col("imgid").alias("_t")).distinct().where(F.col("_t") != source)
    new = t.crossJoin(F.broadcast(own)).withColumn("imgid", F.col("_t")).drop("_t")  # one image's entries, one per operation
    keys = ["imgid", "operation", "multi_priority"]
    touched = history.join(t, history.imgid == t["_t"], "left_semi")
    others = history.join(t, history.imgid == t["_t"], "left_anti")
    if merge:
        ends = touched.groupBy("imgid").agg((F.max("num") + 1).alias("_end"))
        new = new.join(ends, "imgid", "left").withColumn("num", (F.col("num") + F.coalesce("_end", F.lit(0))).cast("int")).drop("_end")
        others = others.unionByName(touched.join(new.select(*keys), keys, "left_anti").select(*history.columns))
    return others.unionByName(new.select(*history.columns))


def hashes(history: DataFrame) -> DataFrame:
    """imgid and a hash of its enabled latest entries in order."""
    rows = latest(history).where("enabled = 1")
    parts = F.sort_array(F.collect_list(F.struct("num", "operation", "multi_priority", "params")))
    return rows.groupBy("imgid").agg(F.sha2(F.to_json(parts), 256).alias("current_hash"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key, column by column where they have one."""
    both = table.alias("a").join(rows.alias("b"), key, "full")
    return both.select(*(F.col(key) if c == key else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in rows.columns else F.col(f"a.{c}") for c in table.columns))


def apply_style(history: DataFrame, style: DataFrame, targets: DataFrame) -> DataFrame:
    """A style (num, operation, enabled, multi_priority, params) follows each target's history; same operations are replaced."""
    with_id = style.withColumn("imgid", F.lit(-1).cast("long")).select(*history.columns)
    return copy_history(history.unionByName(with_id), -1, targets).where("imgid <> -1")


def create_style(items: DataFrame, history: DataFrame, imgid: int, name: str, operations: list[str] | None = None) -> DataFrame:
    """A style from the latest entries of an image's history (of some operations), numbered from 0; a style of that name is replaced."""
    own = latest(history.where(F.col("imgid") == imgid))
    own = own if operations is None else own.where(F.col("operation").isin(operations))
    number = F.row_number().over(Window.partitionBy("imgid").orderBy("num", "operation", "multi_priority")) - 1  # one image's entries
    new = own.withColumn("num", number.cast("int")).withColumn("name", F.lit(name))
    return delete_styles(items, [name]).unionByName(new.select(*items.columns))


def update_style(items: DataFrame, history: DataFrame, imgid: int, name: str, gone: list[str] = ()) -> DataFrame:
    """A style without some operations, and with an image's parameters for those that both have."""
    own = latest(history.where(F.col("imgid") == imgid)).select("operation", "multi_priority", F.struct("enabled", "params").alias("_new"))  # one image's entries
    mine = F.col("name") == name
    kept = items.where(~(mine & F.col("operation").isin(list(gone)))).join(F.broadcast(own), ["operation", "multi_priority"], "left")
    changed = {c: F.when(mine & F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("enabled", "params")}
    return kept.select(*(changed.get(c, F.col(c)) for c in items.columns))


def delete_styles(items: DataFrame, names: list[str]) -> DataFrame:
    return items.where(~F.col("name").isin(names))


def style_candidates(style: DataFrame, history: DataFrame, imgid: int) -> DataFrame:
    """A style's items and, besides, the operations of an image's history that it lacks."""
    mine = latest(history.where(F.col("imgid") == imgid)).select("operation", "multi_priority", "params")
    lacking = mine.join(style, ["operation", "multi_priority"], "left_anti").withColumn("origin", F.lit("history"))
    return style.select("operation", "multi_priority", "params").withColumn("origin", F.lit("style")).union(lacking)


def duplicate(images: DataFrame, chosen: DataFrame) -> DataFrame:
    """Copies of the chosen images with new ids and the next version of their file."""
    top = images.agg(F.max("id").alias("_top"))
    last = images.groupBy("film_id", "filename").agg(F.max("version").alias("_last"))
    picked = images.join(chosen, images.id == chosen.imgid, "left_semi")
    nth = F.row_number().over(Window.partitionBy("film_id", "filename").orderBy("id"))
    new = picked.join(last, ["film_id", "filename"]).withColumn("version", (F.col("_last") + nth).cast("int")).crossJoin(F.broadcast(top))  # one row
    new = new.withColumn("id", F.col("_top") + F.col("id"))  # ids from the highest on: unique without a global count
    return images.unionByName(new.select(*images.columns))


def not_imported(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """Candidates (filename, datetime_taken) whose key ``filename-datetime`` no image has."""
    key = lambda: F.concat_ws("-", "filename", F.col("datetime_taken").cast("string"))
    return candidates.withColumn("_k", key()).join(images.select(key().alias("_k")), "_k", "left_anti").drop("_k")


# --- order and paging


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """rowid from 1 in the order, without sending all rows to one task: a range sort, counts per part, then a sum before each."""
    return global_rank(df, order)


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """New positions: the place in the high word, room for moves in the low."""
    return numbered(df, order).withColumn("position", F.shiftleft(F.col("rowid"), 32)).drop("rowid")


def move_before(images: DataFrame, moved: DataFrame, target: int) -> DataFrame:
    """Moved images stand, in their order, before the target: they share the gap between it and its predecessor."""
    at = images.where(F.col("id") == target).select(F.col("position").alias("_to"))
    m = moved.select(F.col("imgid").alias("id")).distinct().withColumn("_m", F.lit(True))
    out = images.join(m, "id", "left").crossJoin(F.broadcast(at))  # one row
    gap = out.where("_m is null and position < _to").agg(F.coalesce(F.max("position"), F.lit(0)).alias("_from"))
    count = out.where("_m").agg((F.count(F.lit(1)) + 1).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_m").orderBy("position", "id"))
    ranked = out.where("_m").withColumn("_r", place).crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(count))  # one row each
    ranked = ranked.withColumn("position", F.col("_from") + F.expr("(_to - _from) div _n") * F.col("_r"))
    return out.where("_m is null").select(*images.columns).unionByName(ranked.select(*images.columns))


def circular(numbered_: DataFrame, start: int, total: int) -> DataFrame:
    """Rows renumbered so that ``start`` comes first and what precedes it comes last."""
    r = F.col("rowid")
    return numbered_.withColumn("newrow", F.when(r >= start, r - start + 1).otherwise(r + total - start + 1))


def page_after(df: DataFrame, rowid: int, size: int, backwards: bool = False) -> DataFrame:
    """Keyset paging."""
    c = F.col("rowid")
    return df.where(c < rowid).orderBy(c.desc()).limit(size) if backwards else df.where(c > rowid).orderBy(c).limit(size)


def next_outside(numbered_: DataFrame, gone: DataFrame) -> DataFrame:
    """The first row after a set of rows, or else the last before it: (rowid)."""
    g = numbered_.join(gone, numbered_.id == gone.imgid, "left_semi").agg(F.min("rowid").alias("a"), F.max("rowid").alias("b"))
    rest = numbered_.join(gone, numbered_.id == gone.imgid, "left_anti").crossJoin(F.broadcast(g))  # one row
    return rest.agg(F.coalesce(F.min(F.when(F.col("rowid") > F.col("b"), F.col("rowid"))), F.max(F.when(F.col("rowid") < F.col("a"), F.col("rowid")))).alias("rowid"))
