import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigrid.functions import parsing
from lumigrid.functions.calculator import compile_formula, evaluate
from lumigrid.functions.template import compile_template


@pytest.mark.parametrize(("text", "operator", "low", "high"), [("5", None, 5, None), (" >= -2.5 ", ">=", -2.5, None), ("[1; 3]", "[]", 1, 3), ("<>0", "<>", 0, None)])
def test_numbers(text, operator, low, high):
    assert parsing.number(text) == parsing.Comparison(operator, low, high)


@pytest.mark.parametrize("text", ["", "many", "[1;", "1;2", "=>3", "1 2"])
def test_what_is_no_number(text):
    assert parsing.number(text) is None


@given(st.text(max_size=30))
def test_parsers_never_raise(text):
    parsing.number(text)
    parsing.exposure(text)
    parsing.moment(text, datetime(2020, 1, 1))
    parsing.split_list(text)
    assert math.isnan(evaluate(text)) or isinstance(evaluate(text), float)


def test_partial_dates_stand_for_their_unit():
    us = parsing.microseconds
    assert parsing.moment("2004") == parsing.Comparison("=", us(datetime(2004, 1, 1)), us(datetime(2005, 1, 1)) - 1)
    assert parsing.moment("2004:02") == parsing.Comparison("=", us(datetime(2004, 2, 1)), us(datetime(2004, 3, 1)) - 1)
    assert parsing.moment(">2004").low == us(datetime(2005, 1, 1)) - 1
    found = parsing.moment("[-0000:01;2004:03:31]")
    assert found.low == us(datetime(2004, 2, 29, 23, 59, 59, 999999))


def test_exposure_fractions():
    assert parsing.exposure("1/125").low == 1 / 125
    assert parsing.exposure('[1/60;2.5"]') == parsing.Comparison("[]", 1 / 60, 2.5)


def test_lists_and_wildcards():
    assert parsing.split_list('a,"b,c",d') == ["a", '"b,c"', "d"]
    assert [parsing.wildcards(t) for t in ("x", '"x', 'x"', '"x"')] == ["%x%", "x%", "%x", "x"]


@pytest.mark.parametrize(("text", "value"), [("1+2*3", 7), ("2^3^2", 64), ("3:2", 1.5), ("2:3", 1.5), ("-(1-4)", 3), ("x*2", 10), ("7%4", 3), ("1,5+1", 2.5)])
def test_calculator(spark, text, value):
    assert evaluate(text, 5) == pytest.approx(value)
    assert spark.range(1).select(compile_formula(text, F.lit(5.0))).first()[0] == pytest.approx(value)


TEMPLATES = [
    ("$(NAME)", "abcdef12345abcdef"), ("$(NOPE)", ""), ("$(NAME:5)", "f12345abcdef"), ("$(NAME:5:3)", "f12"), ("$(NAME:5:-3)", "f12345abc"), ("$(NAME:-7)", "5abcdef"), ("$(NAME:-7:-2)", "5abcd"),
    ("$(NAME:42)", ""), ("$(NAME:-42)", "abcdef12345abcdef"), ("$(NAME#abc)", "def12345abcdef"), ("$(NAME%def)", "abcdef12345abc"), ("$(NAME#def)", "abcdef12345abcdef"), ("$(NAME/abc/X)", "Xdef12345abcdef"),
    ("$(NAME//abc/X)", "Xdef12345Xdef"), ("$(NAME/#abc/X)", "Xdef12345abcdef"), ("$(NAME/%def/X)", "abcdef12345abcX"), ("$(NAME^)", "Abcdef12345abcdef"), ("$(NAME^^)", "ABCDEF12345ABCDEF"), ("$(JOB,)", "aBCDEF"), ("$(JOB,,)", "abcdef"),
    ("$(NOPE-x$(JOB)y)", "xABCDEFy"), ("$(NAME+set)", "set"), ("a$(JOB)b", "aABCDEFb"), ("$(JOB", "$(JOB"),
]


def test_templates(spark):
    v = {"NAME": F.lit("abcdef12345abcdef"), "JOB": F.lit("ABCDEF")}
    row = spark.range(1).select(*(compile_template(t, v).alias(f"t{i}") for i, (t, _) in enumerate(TEMPLATES))).first()
    assert list(row) == [want for _, want in TEMPLATES]


def test_colours_go_there_and_back(spark):
    from lumigrid.functions import color

    rgb = np.random.default_rng(0).random((200, 3)).tolist()
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rgb)], "i int, c0 double, c1 double, c2 double")
    for there, back, near in ((color.rgb_to_lab, color.lab_to_rgb, 1e-5), (color.rgb_to_hsl, color.hsl_to_rgb, 1e-9), (color.rgb_to_hsv, color.hsv_to_rgb, 1e-9), (color.srgb_to_linear, color.linear_to_srgb, 1e-6), (color.xyz_to_prophoto, color.prophoto_to_xyz, 1e-5), (color.d50_to_d65, color.d65_to_d50, 1e-5), (color.rgb_to_ycbcr, color.ycbcr_to_rgb, 1e-4), (color.xyz_to_xyy, color.xyy_to_xyz, 1e-9), (color.xyy_to_uvy, color.uvy_to_xyy, 1e-9)):
        got = np.array([[r.c0, r.c1, r.c2] for r in back(there()).apply(df).orderBy("i").collect()])
        assert np.abs(got - rgb).max() < near, there.__name__


def test_known_colours(spark):
    from lumigrid.functions import color

    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "c0 double, c1 double, c2 double")
    white = color.rgb_to_lab().apply(df).first()
    assert (white.c0, white.c1, white.c2) == pytest.approx((100, 0, 0), abs=0.05)
    assert tuple(color.rgb_to_hsl().apply(spark.createDataFrame([(1.0, 0.0, 0.0)], "c0 double, c1 double, c2 double")).select("c0", "c1", "c2").first()) == (0.0, 1.0, 0.5)


def test_ranks_of_more_rows_than_a_range_sort_samples(spark):
    """Counts of parts must be of the parts that the rows are in, though a sample of them sets the bounds."""
    from pyspark.sql import functions as F

    from lumigrid.functions.ranks import global_rank

    rows = spark.range(0, 60_000, 1, 2).select("id", F.md5(F.col("id").cast("string")).alias("name"), F.col("id").alias("more"))
    got = [r.id for r in global_rank(rows, [F.col("name")], "place").orderBy("place").select("id", "place").collect()]
    assert got == [r.id for r in rows.orderBy("name").collect()]
    places = global_rank(rows, [F.col("name")], "place").agg(F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(places) == (60_000, 1, 60_000)
