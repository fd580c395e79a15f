"""Boolean trees over row expressions and membership tests, lowered to joins.

A membership test is a set of ids from another table. Where it stands alone in a conjunction it
becomes a left semi or left anti join; anywhere else its outcome joins as a flag, once per set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_numbers = count()


@dataclass(frozen=True)
class Test:
    """A boolean expression of the row."""

    column: Column


@dataclass(frozen=True)
class Member:
    """Whether the row's ``key`` is among ``ids`` (one column, any name)."""

    ids: DataFrame
    key: str = "id"
    absent: bool = False


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple



def negated(p):
    if isinstance(p, Member):
        return Member(p.ids, p.key, not p.absent)
    if isinstance(p, Not):
        return p.part
    return Not(p)


def _flagged(df: DataFrame, p) -> tuple[DataFrame, Column]:
    if p is None:
        return df, F.lit(True)
    if isinstance(p, Test):
        return df, F.coalesce(p.column, F.lit(False))
    if isinstance(p, Member):
        flag = f"_in{next(_numbers)}"
        ids = p.ids.toDF("_id").where("_id is not null").distinct().withColumn(flag, F.lit(True))
        df = df.join(ids, df[p.key] == ids["_id"], "left").drop("_id")
        there = F.col(flag).isNotNull()
        return df, ~there if p.absent else there
    if isinstance(p, Not):
        df, c = _flagged(df, p.part)
        return df, ~c
    columns = []
    for part in p.parts:
        df, c = _flagged(df, part)
        columns.append(c)
    return df, reduce((lambda a, b: a & b) if isinstance(p, All) else (lambda a, b: a | b), columns, F.lit(isinstance(p, All)))


def keep(df: DataFrame, p) -> DataFrame:
    """The rows for which ``p`` holds; columns as before. Tests that are unknown (null) count as false."""
    if p is None:
        return df
    if isinstance(p, All):
        tests = [x for x in p.parts if not isinstance(x, Member)]
        for x in [*tests, *(x for x in p.parts if isinstance(x, Member))]:  # cheap row tests first, so they reach the scan
            df = keep(df, x)
        return df
    if isinstance(p, Test):
        return df.where(p.column)
    if isinstance(p, Member):
        ids = p.ids.toDF("_id").where("_id is not null")
        return df.join(ids, df[p.key] == ids["_id"], "left_anti" if p.absent else "left_semi")
    names = df.columns
    df, c = _flagged(df, p)
    return df.where(c).select(*names)
