"""Collections: rules over a catalog, compiled to one lazy plan.

A rule is (property, text, mode). Rules read from left to right like SQL text, so AND binds
closer than OR. What a rule's text does not parse to holds for every image.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.ranks import global_rank
from .catalog import COLORS, HDR, LDR, LOCAL_COPY, MODULE_ORDERS, RAW, REJECTED, REMOVED, Catalog, bits, rating
from .logic import All, Any, Member, Not, Test, keep, negated

MOST_RULES = 10


@dataclass(frozen=True)
class Rule:
    property: str
    text: str = ""
    mode: str = "AND"  # AND, OR, AND NOT
    off: bool = False


@dataclass(frozen=True)
class Sort:
    key: str
    descending: bool = False


@dataclass(frozen=True)
class Collection:
    """Rules, filters and sorts (at most MOST_RULES of each, more raise), an order, grouping and paging."""

    rules: tuple[Rule, ...] = ()
    filters: tuple[Rule, ...] = ()
    sorts: tuple[Sort, ...] = ()
    film_id: int | None = None
    grouped: bool = False
    expanded_group: int | None = None
    offset: int = 0
    limit: int | None = None
    seed: int = 0
    tags_insensitive: bool = True
    strict_compat: bool = False  # also reproduce that "<>" on dates never holds

    def __post_init__(self):
        if max(map(len, (self.rules, self.filters, self.sorts))) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules, filters or sorts")

    def without(self, number: int) -> Collection:
        """For the facets of rule ``number``: all other rules, unless the rule is joined by OR."""
        if self.rules[number].mode == "OR":
            return self
        return replace(self, rules=tuple(replace(r, off=True) if i == number else r for i, r in enumerate(self.rules)))

    def where(self, catalog: Catalog) -> DataFrame:
        """The images that the rules, filters and base conditions keep, unordered."""
        df = catalog["images"].where(bits("flags", REMOVED) == 0)
        if self.film_id is not None:
            df = df.where(F.col("film_id") == self.film_id)
        parts = [p for rules in (self.rules, self.filters) if (p := combine(rules, catalog, self)) is not None]
        df = keep(df, All(tuple(parts))) if parts else df
        return representatives(df, self.expanded_group) if self.grouped else df

    def count(self, catalog: Catalog) -> int:
        return self.where(catalog).select("id").distinct().count()

    def query(self, catalog: Catalog) -> DataFrame:
        """The ordered page. A limit becomes a bounded top-k, never a sort of everything."""
        df, keys = ordering(self.where(catalog), self.sorts, catalog, self.seed)
        names = catalog["images"].columns
        df = df.orderBy(*keys)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None and self.limit >= 0:
            df = df.limit(self.limit)
        return df.select(*names)

    def ranked(self, catalog: Catalog) -> DataFrame:
        """All images with their place from 1 in the order, none left out."""
        df, keys = ordering(self.where(catalog), self.sorts, catalog, self.seed)
        return global_rank(df, keys, "place").select(*catalog["images"].columns, "place")


def representatives(df: DataFrame, expanded: int | None = None) -> DataFrame:
    """One image per group: the one nearest its group's id, on a tie the one above it; an expanded group is shown whole."""
    distance = F.abs(F.col("id") - F.col("group_id")) * 2 + (F.col("id") < F.col("group_id")).cast("int")
    chosen = df.groupBy("group_id").agg(F.min_by("id", F.struct(distance, F.col("id"))).alias("_chosen"))
    out = df.join(chosen, "group_id")
    shown = F.col("id") == F.col("_chosen")
    if expanded is not None:
        shown = shown | (F.col("group_id") == expanded)
    return out.where(shown).select(*df.columns)


def combine(rules, catalog: Catalog, spec: Collection):
    """AND before OR, as in SQL text. An empty text says nothing, except that after OR it says "all"."""
    alternatives: list[list] = [[]]
    for r in rules:
        if r.off:
            continue
        if not r.text:
            if r.mode == "OR":
                alternatives.append([Test(F.lit(True))])
            continue
        p = predicate(r.property, r.text, catalog, spec)
        p = Test(F.lit(True)) if p is None else p
        if r.mode == "OR" and alternatives != [[]]:
            alternatives.append([p])
        else:
            alternatives[-1].append(negated(p) if r.mode == "AND NOT" else p)
    whole = [All(tuple(a)) for a in alternatives if a]
    if not whole:
        return None
    return whole[0] if len(whole) == 1 else Any(tuple(whole))


def _compare(c: Column, found: parsing.Comparison | None):
    """Range, operator or equality on a column; None if nothing was parsed."""
    if found is None or found.low is None:
        return None
    if found.operator == "[]":
        return None if found.high is None else Test(c.between(found.low, found.high))
    return Test({"<": c < found.low, ">": c > found.low, "<=": c <= found.low, ">=": c >= found.low, "<>": c != found.low}.get(found.operator, c == found.low))


def _named(catalog: Catalog, table: str, key: str, text: str):
    """Names of a dimension, any of a quoted list; "unnamed" stands for missing and blank ones."""
    names = catalog[table].select("id", F.coalesce(F.trim("name"), F.lit("")).alias("name"))
    wanted = [F.col("name") == "" if t.strip('"') == "unnamed" else F.col("name").ilike(parsing.wildcards(t)) for t in parsing.split_list(text)]
    if not wanted:
        return None
    test = wanted[0]
    for w in wanted[1:]:
        test = test | w
    found = Member(names.where(test).select("id"), key)
    if any(t.strip('"') == "unnamed" for t in parsing.split_list(text)):
        return Any((found, Test(F.col(key).isNull())))
    return found


def _filename(text: str, catalog: Catalog):
    """names/extensions; commas are alternatives; RAW, NOT RAW, LDR and HDR name kinds of files."""
    names, _, kinds = text.partition("/")
    parts = []
    if wanted := parsing.split_list(names):
        parts.append(Any(tuple(Test(F.col("filename").ilike(parsing.wildcards(n))) for n in wanted)))
    known = {"RAW": bits("flags", RAW) != 0, "NOT RAW": bits("flags", RAW) == 0, "LDR": bits("flags", LDR) != 0, "HDR": bits("flags", HDR) != 0}
    if wanted := parsing.split_list(kinds):
        parts.append(Any(tuple(Test(known[k.strip('"')]) if k.strip('"') in known else Test(F.col("filename").ilike("%." + k.strip('"').lstrip("."))) for k in wanted)))
    return All(tuple(parts)) if parts else None


def _color(text: str, catalog: Catalog):
    labels = catalog["color_labels"]
    if text.strip() in ("", "%"):
        return Member(labels.where("color is not null").select("imgid"))
    if not text.startswith("0x"):
        color = COLORS.index(text) if text in COLORS else 0
        return Member(labels.where(F.col("color") == color).select("imgid"))
    try:
        value = int(text[2:], 16)
    except ValueError:
        return None
    wanted, banned, every = value & 0xFFF, value >> 12 & 0xFFF, bool(value & 0x80000000)
    masks = labels.groupBy("imgid").agg(F.expr("bit_or(shiftleft(1, color))").alias("mask"))
    some = lambda test: masks.where(test).select("imgid")
    if every:
        if wanted:
            return Member(some((bits("mask", wanted) == wanted) & (bits("mask", banned) == 0)))
        return Member(some(bits("mask", banned) != 0), absent=True) if banned else None
    has = Member(some(bits("mask", wanted) != 0))
    return Any((has, Member(some(bits("mask", banned) == banned), absent=True))) if banned else has


def _tag(text: str, catalog: Catalog, insensitive: bool):
    links, tags, name = catalog["tagged_images"], catalog["tags"], F.col("name")
    if text == "not tagged":
        return Member(links.join(catalog.user_tags(), F.col("tagid") == F.col("id"), "left_semi").select("imgid"), absent=True)
    if text.endswith("*"):
        t = text[:-1]
        test = name.ilike(t) | name.ilike(t + "|%") if insensitive else (name == t) | name.startswith(t + "|")
    elif insensitive:
        test = name.ilike(text)
    else:
        test = name.startswith(text[:-1]) if text.endswith("%") else name == text
    return Member(links.join(tags.where(test), F.col("tagid") == F.col("id"), "left_semi").select("imgid"))


def _geotag(text: str, catalog: Catalog):
    placed = Test(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    if text == "not tagged":
        return Not(placed)
    if text == "tagged*":
        return placed
    root, rest = catalog.location_root, "|" + text.split("|", 1)[1] if "|" in text else ""
    name = F.col("name")
    if rest.endswith("*"):
        test = name.ilike(root + rest[:-1]) | name.ilike(root + rest[:-1] + "|%")
    else:
        test = name.ilike(root + (rest or "%"))
    found = catalog["tagged_images"].join(catalog["tags"].where(test), F.col("tagid") == F.col("id"), "left_semi").select("imgid")
    return All((placed, Member(found, absent=text == "tagged")))


def _when(column: str, text: str, spec: Collection):
    found, c = parsing.moment(text), F.col(column)
    if found is None:
        return None
    if found.operator == "[]":
        tests = [c >= found.low] * (found.low is not None) + [c <= found.high] * (found.high is not None)
        return All(tuple(map(Test, tests)))
    if found.operator == "=":
        return Test(c.between(found.low, found.high))
    if found.operator == "<>":
        below, above = c < found.low, c > found.high
        return Test(below & above) if spec.strict_compat else Test(below | above)
    return _compare(c, found)


def _exposure(text: str):
    found, c, near = parsing.exposure(text), F.col("exposure"), 1e-5
    if found is None or found.low is None:
        return None
    if found.operator == "[]":
        return None if found.high is None else Test((c >= found.low - near) & (c <= found.high + near))
    if found.operator in ("<", ">", "<=", ">="):
        return _compare(c, found)
    shown = F.when(c < 0.4, c).otherwise(F.round(c, 2))
    equal = shown.between(found.low - near, found.low + near)
    return Test(~equal if found.operator == "<>" else equal)


def _rating(text: str):
    found, flags = parsing.number(text), F.col("flags")
    if found is None:
        return None
    stars, rejected = bits(flags, 7), bits(flags, REJECTED) != 0
    low = int(found.low)
    if found.operator == "[]":
        high = int(found.high)
        if low == -1:  # rejected ones too, whatever their stars
            return Test(stars.between(low, high))
        return Test(stars.between(low, high) & ~rejected)
    if found.operator in ("<", "<="):
        return Test((stars < low if found.operator == "<" else stars <= low) | rejected)
    if found.operator in (">", ">="):
        inside = stars > low if found.operator == ">" else stars >= low
        return Test(inside & ~rejected) if low >= 0 else Test(inside)
    if low == -1:
        return Test(~rejected if found.operator == "<>" else rejected)
    return Test((stars != low) | rejected) if found.operator == "<>" else Test((stars == low) & ~rejected)


def _history(text: str, catalog: Catalog):
    h = catalog["history_hash"]
    current, basic, auto = F.col("current_hash"), F.col("basic_hash"), F.col("auto_hash")
    altered = basic.isNull() | (current != basic)
    if text in ("basic", "$BASIC"):
        return Member(h.where(altered).select("imgid"), absent=True)
    if text in ("auto applied", "$AUTO_APPLIED"):
        return Member(h.where(current == auto).select("imgid"))
    if text in ("altered", "$ALTERED"):
        return Member(h.where(altered & (auto.isNull() | (current != auto))).select("imgid"))
    return None


def _search(text: str, catalog: Catalog):
    """In metadata values, tags and their synonyms, file names, makers and models, and folders."""
    pattern = parsing.wildcards(text) if text.strip() else "%%"
    if pattern == "%%":
        return None
    like = lambda *names: [F.col(n).ilike(pattern) for n in names]
    name, synonyms = like("name", "synonyms")
    tags = catalog["tags"].where(name | synonyms)
    return Any(
        (
            Member(catalog["meta_data"].where(like("value")[0]).select("imgid")),
            Member(catalog["tagged_images"].join(tags, F.col("tagid") == F.col("id"), "left_semi").select("imgid")),
            Test(like("filename")[0]),
            Member(catalog["cameras"].where(like("maker")[0] | like("model")[0]).select("id"), "camera_id"),
            Member(catalog["film_rolls"].where(like("folder")[0]).select("id"), "film_id"),
        )
    )


def _camera(text: str, catalog: Catalog):
    cams = catalog["cameras"].select("id", F.trim(F.concat_ws(" ", "maker", "model")).alias("name"))
    return _named(Catalog({"cameras": cams}), "cameras", "camera_id", text)


def _order(text: str, catalog: Catalog):
    known = {n.lower(): i for i, n in enumerate(MODULE_ORDERS)}
    if text.strip().isdigit():
        return Member(catalog["module_order"].where(F.col("version") == int(text)).select("imgid"))
    if text.lower() in known:
        return Member(catalog["module_order"].where(F.col("version") == known[text.lower()]).select("imgid"))
    return Member(catalog["module_order"].select("imgid"), absent=True)


def _folder(text: str, catalog: Catalog):
    rolls, folder = catalog["film_rolls"], F.col("folder")
    if text.endswith("*"):
        test = folder.ilike(text[:-1]) | folder.ilike(text[:-1] + "/%")
    elif text.endswith("|%"):
        test = folder.ilike(text[:-2] + "/%")
    else:
        test = folder.ilike(text)
    return Member(rolls.where(test).select("id"), "film_id")


def _aspect(text: str):
    found, c = parsing.number(text), F.col("aspect_ratio")
    if found is None:
        return Test(c.cast("string").ilike(f"%{text}%"))
    return _compare(c if found.operator else F.round(c, 2), found)


def _focal(text: str):
    found, c = parsing.number(text), F.col("focal_length")
    if found is not None and found.operator is None:
        return Test(c.cast("int") == int(found.low))
    return _compare(c, found)


TIMES = {"day": "datetime_taken", "time": "datetime_taken", "import_timestamp": "import_timestamp", "change_timestamp": "change_timestamp", "export_timestamp": "export_timestamp", "print_timestamp": "print_timestamp"}
DIMENSIONS = {"lens": "lens_id", "whitebalance": "whitebalance_id", "flash": "flash_id", "exposure_program": "exposure_program_id", "metering_mode": "metering_mode_id"}
PROPERTIES = ("filmroll", "folders", "color", "history", "geotagging", "local_copy", "aspect_ratio", "camera", "tag", *DIMENSIONS, "group_id", "focal_length", "iso", "aperture", "exposure", "exposure_bias", "filename", *TIMES, "module", "order", "textsearch", "rating", "rating_range", "metadata:<key>")


def predicate(prop: str, text: str, catalog: Catalog, spec: Collection = Collection()):
    """The test of one rule, or None where it holds for all."""
    if prop in TIMES:
        return _when(TIMES[prop], text, spec)
    if prop in DIMENSIONS:
        return _named(catalog, prop, DIMENSIONS[prop], text)
    if prop.startswith("metadata:"):
        key = int(prop.split(":")[1])
        rows = catalog["meta_data"].where(F.col("key") == key)
        if text == "not defined":
            return Member(rows.select("imgid"), absent=True)
        return Member(rows.where(F.col("value").ilike(parsing.wildcards(text))).select("imgid"))
    if prop == "filmroll":
        return Member(catalog["film_rolls"].where(F.col("folder").ilike(text or "%")).select("id"), "film_id")
    if prop == "folders":
        return _folder(text, catalog)
    if prop == "color":
        return _color(text, catalog)
    if prop == "history":
        return _history(text, catalog)
    if prop == "geotagging":
        return _geotag(text, catalog)
    if prop == "local_copy":
        here = bits("flags", LOCAL_COPY) != 0
        return Test(~here) if text in ("not copied locally", "$NO_LOCAL_COPY") else Test(here) if text in ("copied locally", "$LOCAL_COPY") else None
    if prop == "aspect_ratio":
        return _aspect(text)
    if prop == "camera":
        return _camera(text, catalog)
    if prop == "tag":
        return _tag(text, catalog, spec.tags_insensitive)
    if prop == "group_id":
        return Test(F.col("group_id").cast("string").ilike(parsing.wildcards(text)))
    if prop == "focal_length":
        return _focal(text)
    if prop == "iso":
        return _compare(F.col("iso"), parsing.number(text))
    if prop == "aperture":
        return _compare(F.round("aperture", 1), parsing.number(text))
    if prop == "exposure":
        return _exposure(text)
    if prop == "exposure_bias":
        found = parsing.number(text)
        return _compare(F.round("exposure_bias", 2), found)
    if prop == "filename":
        return _filename(text, catalog)
    if prop == "module":
        return Member(catalog["history"].where((F.col("enabled") == 1) & F.col("operation").ilike(text)).select("imgid"))
    if prop == "order":
        return _order(text, catalog)
    if prop == "textsearch":
        return _search(text, catalog)
    if prop in ("rating", "rating_range"):
        return _rating(text)
    raise ValueError(f"unknown property {prop}")


#: Sort keys: columns (or computed ones) and whether the direction is turned round.
SORT_KEYS = ("filename", "datetime", "import_timestamp", "change_timestamp", "export_timestamp", "print_timestamp", "rating", "id", "color", "group", "path", "custom", "title", "description", "aspect_ratio", "shuffle")
METADATA_KEYS = {"title": 0, "description": 1}


def ordering(df: DataFrame, sorts, catalog: Catalog, seed: int = 0) -> tuple[DataFrame, list[Column]]:
    """The frame with what its order needs, and the order: the sorts, then file name (if not among them) and version."""
    keys: list[Column] = []
    way = lambda c, down: c.desc_nulls_last() if down else c.asc_nulls_first()
    for s in sorts:
        if s.key == "rating":
            keys.append(way(rating(), s.descending))
        elif s.key == "datetime":
            keys.append(way(F.col("datetime_taken"), s.descending))
        elif s.key == "color":  # plain means falling here
            labels = catalog["color_labels"].groupBy(F.col("imgid").alias("id")).agg(F.max("color").alias("_color"))
            df = df.join(labels, "id", "left")
            keys.append(way(F.col("_color"), not s.descending))
        elif s.key == "group":
            keys += [way(F.col("group_id"), s.descending), (F.col("id") != F.col("group_id")).asc(), F.col("id").asc()]
        elif s.key == "path":
            df = df.join(catalog["film_rolls"].select(F.col("id").alias("film_id"), F.col("folder").alias("_folder")), "film_id")
            keys += [way(F.col("_folder"), s.descending), way(F.col("filename"), s.descending)]
        elif s.key == "custom":
            keys.append(way(F.col("position"), s.descending))
        elif s.key in METADATA_KEYS:
            value = catalog["meta_data"].where(F.col("key") == METADATA_KEYS[s.key]).groupBy(F.col("imgid").alias("id")).agg(F.min("value").alias(f"_{s.key}"))
            df = df.join(value, "id", "left")
            keys.append(way(F.col(f"_{s.key}"), s.descending))
        elif s.key == "shuffle":
            keys.append(F.xxhash64(F.col("id"), F.lit(seed)).asc())
        elif s.key in SORT_KEYS:
            keys.append(way(F.col(s.key), s.descending))
        else:
            raise ValueError(f"unknown sort key {s.key}")
    if not any(s.key == "filename" for s in sorts):
        keys.append(way(F.col("filename"), bool(sorts) and sorts[0].descending))
    return df, [*keys, F.col("version").asc(), F.col("id").asc()]


def numbered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows with their place ``rowid`` from 1 in the order."""
    return global_rank(df, keys)


def serialize(rules: tuple[Rule, ...]) -> str:
    """Rules as text: count, then mode:off:property:text for each, separated by $."""
    modes = ("AND", "OR", "AND NOT")
    return f"{len(rules)}:" + "$".join(f"{modes.index(r.mode)}:{int(r.off)}:{r.property.replace(':', '=')}:{r.text}" for r in rules)


def deserialize(text: str) -> tuple[Rule, ...]:
    """What serialize wrote; parts that don't parse are skipped."""
    modes, out = ("AND", "OR", "AND NOT"), []
    for part in text.partition(":")[2].split("$"):
        bits_ = part.split(":", 3)
        if len(bits_) == 4 and bits_[0] in ("0", "1", "2"):
            out.append(Rule(bits_[2].replace("=", ":"), bits_[3], modes[int(bits_[0])], bits_[1] == "1"))
    return tuple(out)
