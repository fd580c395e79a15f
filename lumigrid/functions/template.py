"""File name templates: $(NAME) with operators, compiled to one column expression.

    $(V-alt)  alt if V is empty          $(V+alt)  alt if V is set
    $(V:o) $(V:o:n)  part by characters, negative ones from the end
    $(V#p) $(V%p)  without a prefix, suffix
    $(V/p/r) $(V//p/r) $(V/#p/r) $(V/%p/r)  first, all, prefix, suffix replaced
    $(V^) $(V^^) $(V,) $(V,,)  upper and lower case, first or all

Alternatives may hold further $(…). Unknown names are empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_."


def compile_template(text: str, variables: Mapping[str, Column]) -> Column:
    out, at = _text(text, 0, variables, "")
    return out


def _concat(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def _text(s: str, at: int, variables, ends: str) -> tuple[Column, int]:
    """Literal text and variables up to a character of ``ends``."""
    parts, literal = [], []

    def flush():
        if literal:
            parts.append(F.lit("".join(literal)))
            literal.clear()

    while at < len(s) and s[at] not in ends:
        if s.startswith("$(", at):
            value, stop = _variable(s, at + 2, variables)
            if stop is None:
                literal.append(s[at])
                at += 1
                continue
            flush()
            parts.append(value)
            at = stop
        else:
            if s[at] == "\\" and at + 1 < len(s):
                at += 1
            literal.append(s[at])
            at += 1
    flush()
    return _concat(parts), at


def _variable(s: str, at: int, variables) -> tuple[Column | None, int | None]:
    start = at
    while at < len(s) and s[at] in _NAME:
        at += 1
    name = s[start:at]
    value = F.coalesce(variables[name].cast("string"), F.lit("")) if name in variables else F.lit("")
    if at >= len(s):
        return None, None
    op = s[at]
    if op == ")":
        return value, at + 1
    if op in "-+":
        other, at = _text(s, at + 1, variables, ")")
        value = F.when((value == "") if op == "-" else (value != ""), other).otherwise(value)
    elif op == ":":
        stop = s.find(")", at)
        if stop < 0:
            return None, None
        value, at = _part(value, s[at + 1 : stop]), stop
    elif op in "#%":
        fix, at = _text(s, at + 1, variables, ")")
        value = _strip(value, fix, op == "#", F.lit(""))
    elif op == "/":
        value, at = _replace(s, at + 1, value, variables)
    elif op in "^,":
        change = F.upper if op == "^" else F.lower
        if s.startswith(op * 2, at):
            value, at = change(value), at + 2
        else:
            value, at = F.concat(change(F.substring(value, 1, 1)), value.substr(F.lit(2), F.length(value))), at + 1
    else:
        return None, None
    return (value, at + 1) if at < len(s) and s[at] == ")" else (None, None)


def _part(value: Column, spec: str) -> Column:
    """By offset and length; an offset before the start takes all, one past the end nothing."""
    offset, _, length = spec.partition(":")
    try:
        o = int(offset or 0)
        n = int(length) if length else None
    except ValueError:
        return value
    size = F.length(value)
    start = F.lit(o) if o >= 0 else F.when(-F.lit(o) > size, F.lit(0)).otherwise(size + o)
    start = F.least(start, size)
    if ":" in spec and n is None:
        return F.lit("")
    stop = size if n is None else F.least(start + n, size) if n >= 0 else F.greatest(size + n, start)
    return F.when(stop > start, value.substr(start + 1, stop - start)).otherwise(F.lit(""))


def _strip(value: Column, fix: Column, front: bool, new: Column) -> Column:
    n = F.length(fix)
    rest = value.substr(n + 1, F.length(value)) if front else value.substr(F.lit(1), F.length(value) - n)
    hit = F.startswith(value, fix) if front else F.endswith(value, fix)
    changed = F.concat(new, rest) if front else F.concat(rest, new)
    return F.when(hit & (n > 0), changed).otherwise(value)


def _replace(s: str, at: int, value: Column, variables) -> tuple[Column, int]:
    mode = s[at] if at < len(s) and s[at] in "/#%" else ""
    pattern, at = _text(s, at + len(mode), variables, "/)")
    new, at = _text(s, at + 1, variables, ")") if at < len(s) and s[at] == "/" else (F.lit(""), at)
    if mode in ("#", "%"):
        return _strip(value, pattern, mode == "#", new), at
    if mode == "/":
        return F.when(pattern != "", F.replace(value, pattern, new)).otherwise(value), at
    where = F.position(pattern, value)
    first = F.concat(value.substr(F.lit(1), where - 1), new, value.substr(where + F.length(pattern), F.length(value)))
    return F.when((where > 0) & (pattern != ""), first).otherwise(value), at


def image_variables() -> dict[str, Column]:
    """The usual names over a catalog's image columns (and maker, model, lens, folder where joined)."""
    t = F.expr("timestampadd(MICROSECOND, datetime_taken - 62135596800000000, timestamp_ntz'1970-01-01')")
    fmt = lambda f: F.date_format(t, f)
    flags = F.col("flags")
    stem = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1)
    exposure = F.col("exposure")
    return {
        "YEAR": fmt("yyyy"), "YEAR.SHORT": fmt("yy"), "MONTH": fmt("MM"), "MONTH.SHORT": fmt("MMM"), "MONTH.LONG": fmt("MMMM"), "DAY": fmt("dd"), "HOUR": fmt("HH"), "HOUR.AMPM": fmt("hh a"), "MINUTE": fmt("mm"), "SECOND": fmt("ss"), "MSEC": fmt("SSS"), "DATE": fmt("yyyy-MM-dd"),
        "FILE.NAME": stem, "FILE_NAME": stem, "FILE.EXTENSION": F.regexp_extract("filename", r"\.([^.]*)$", 1), "FILE_EXTENSION": F.regexp_extract("filename", r"\.([^.]*)$", 1),
        "ID": F.col("id"), "IMAGE.ID": F.col("id"), "VERSION": F.col("version"), "FILM.ROLL.ID": F.col("film_id"), "WIDTH.RAW": F.col("width"), "HEIGHT.RAW": F.col("height"),
        "EXIF.ISO": F.col("iso").cast("int"), "EXIF.APERTURE": F.format_number("aperture", 1), "EXIF.FOCAL.LENGTH": F.col("focal_length").cast("int"), "EXIF.EXPOSURE": F.when(exposure < 0.4, F.concat(F.lit("1/"), F.round(1 / exposure).cast("int").cast("string"))).otherwise(F.round(exposure, 1).cast("string")), "EXIF.EXPOSURE.BIAS": F.round("exposure_bias", 2),
        "LONGITUDE": F.round("longitude", 6), "LATITUDE": F.round("latitude", 6), "RATING": F.when(flags.bitwiseAND(F.lit(8)) != 0, F.lit(-1)).otherwise(flags.bitwiseAND(F.lit(7))), "STARS": F.expr("repeat('*', cast(flags & 7 as int))"),
    }
