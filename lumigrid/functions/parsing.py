"""What users type into rules: numbers, dates, exposures, quoted lists and wildcards.

Every parser is lenient: text that it can't read gives None, and the rule then holds for all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

EPOCH = datetime(1, 1, 1)
OPERATORS = ("<=", ">=", "<>", "<", ">", "=")
_NUMBER = r"[-+]?\d+\.?\d*"
_RANGE = re.compile(rf"\s*\[\s*({_NUMBER})\s*;\s*({_NUMBER})\s*\]\s*")
_COMPARE = re.compile(rf"\s*(=|<=|>=|<>|<|>)?\s*({_NUMBER})\s*")
_FRACTION = r'(1/)?(\d+\.?\d*)"?'
_EXPOSURE_RANGE = re.compile(rf"\s*\[\s*{_FRACTION}\s*;\s*{_FRACTION}\s*\]\s*")
_EXPOSURE = re.compile(rf"\s*(=|<=|>=|<>|<|>)?\s*{_FRACTION}\s*")
_DATE_RANGE = re.compile(r"\s*\[\s*([+-]?\d{4}[:.\d\s]*?)\s*;\s*(now|[+-]?\d{4}[:.\d\s]*?)\s*\]\s*")
_DATE = re.compile(r"\s*(=|<=|>=|<>|<|>)?\s*(\d{4}[:.\d\s]*?)\s*%?\s*")


@dataclass(frozen=True)
class Comparison:
    """operator: "[]" for a range, one of OPERATORS, or None for a bare value. low and high are numbers (or microseconds)."""

    operator: str | None
    low: float | None
    high: float | None = None


def number(text: str) -> Comparison | None:
    if m := _RANGE.fullmatch(text):
        return Comparison("[]", float(m[1]), float(m[2]))
    if m := _COMPARE.fullmatch(text):
        return Comparison(m[1], float(m[2]))
    return None


def exposure(text: str) -> Comparison | None:
    """Seconds, perhaps as 1/n or with a second mark."""
    value = lambda inverse, digits: (1 / float(digits) if float(digits) else None) if inverse else float(digits)
    if m := _EXPOSURE_RANGE.fullmatch(text):
        return Comparison("[]", value(m[1], m[2]), value(m[3], m[4]))
    if m := _EXPOSURE.fullmatch(text):
        return Comparison(m[1], value(m[2], m[3]))
    return None


def microseconds(moment: datetime) -> int:
    """Since 0001-01-01."""
    return (moment - EPOCH) // timedelta(microseconds=1)


_FIELDS = re.compile(r"(\d{4})(?:[:-](\d{1,2})(?:[:-](\d{1,2})(?:[\sT]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:[.:](\d{1,6}))?)?)?)?)?)?")


def _fields(text: str) -> list[int] | None:
    m = _FIELDS.fullmatch(text.strip().rstrip(": ."))
    if not m:
        return None
    out = [int(x) for x in m.groups()[:6] if x is not None]
    if m[7]:
        out.append(int(m[7].ljust(6, "0")))
    return out


def _moment(fields: list[int]) -> datetime | None:
    try:
        return datetime(*(fields + [1, 1, 1][len(fields) :])) if len(fields) < 3 else datetime(*fields)
    except ValueError:
        return None


def _shifted(moment: datetime, fields: list[int], sign: int) -> datetime | None:
    """Years and months move the calendar (days past a month's end become its last), the rest is a duration."""
    years, months, days, hours, minutes, seconds, micros = [*fields, *[0] * 7][:7]
    total = moment.year * 12 + moment.month - 1 + sign * (years * 12 + months)
    year, month = divmod(total, 12)
    for day in range(moment.day, 0, -1):
        try:
            out = moment.replace(year=year, month=month + 1, day=day)
        except ValueError:
            if not 1 <= year <= 9999:
                return None
            continue
        try:
            return out + sign * timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds, microseconds=micros)
        except OverflowError:
            return None
    return None


def lower_bound(text: str, now: datetime | None = None) -> datetime | None:
    if text.strip() == "now":
        return now or datetime.now(timezone.utc).replace(tzinfo=None)
    fields = _fields(text)
    return _moment(fields) if fields else None


def upper_bound(text: str, now: datetime | None = None) -> datetime | None:
    """The last microsecond of the unit that the text names."""
    if text.strip() == "now":
        return lower_bound(text, now)
    fields = _fields(text)
    start = _moment(fields) if fields else None
    if start is None:
        return None
    if len(fields) == 7:
        return start
    unit = [0] * len(fields)
    unit[-1] = 1
    end = _shifted(start, unit, 1)
    return end - timedelta(microseconds=1) if end else None


def moment(text: str, now: datetime | None = None) -> Comparison | None:
    """Dates: a partial one stands for its whole unit; in a range, -… or +… is relative to the other bound."""
    if m := _DATE_RANGE.fullmatch(text):
        a, b = m[1], m[2]
        low = None if a.startswith("-") else lower_bound(a.lstrip("+"), now)
        high = None if b.startswith("+") else upper_bound(b.lstrip("-"), now)
        if a.startswith("-") and high and (f := _relative(a[1:])):
            low = _shifted(high, f, -1)
        elif b.startswith("+") and low and (f := _relative(b[1:])):
            high = _shifted(low, f, 1)
        if low is None and high is None:
            return None
        return Comparison("[]", low and microseconds(low), high and microseconds(high))
    if m := _DATE.fullmatch(text):
        low, high = lower_bound(m[2], now), upper_bound(m[2], now)
        if low is None or high is None:
            return None
        if m[1] in (">", "<="):
            return Comparison(m[1], microseconds(high))
        if m[1] in ("<", ">="):
            return Comparison(m[1], microseconds(low))
        return Comparison(m[1] or "=", microseconds(low), microseconds(high))
    return None


def _relative(text: str) -> list[int] | None:
    parts = re.findall(r"\d+", text)
    return [int(p) for p in parts[:6]] + [int(p.ljust(6, "0")) for p in parts[6:7]] if parts else None


def split_list(text: str, separator: str = ",") -> list[str]:
    """Parts at the separator; one in double quotes may hold it, and keeps its quotes."""
    pattern = re.compile(rf'\s*("[^"]*"|[^{re.escape(separator)}]*)\s*(?:{re.escape(separator)}|\Z)')
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            break
        if m[1].strip():
            out.append(m[1].strip())
        at = m.end()
    return out


def wildcards(text: str) -> str:
    """A LIKE pattern: open at both ends unless a quote anchors one."""
    text = text[1:] if text.startswith('"') else "%" + text
    return text[:-1] if text.endswith('"') else text + "%"
