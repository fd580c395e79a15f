"""Queries against their SQL, a broad sample at the smallest scale."""

import math

import pytest

from lumigrid.queries.catalog import ORACLE_SQL, QUERIES
from tests.conftest import DATA

SAMPLE = sorted(k for k in ORACLE_SQL if k.startswith(("rule_rating", "rule_color", "rule_rules", "rule_text", "rule_day", "facet_tag", "facet_history", "facet_date", "join_", "window_", "history_", "rate_", "template_", "formula_", "event_", "kernel_box_mean", "kernel_sharpen", "kernel_highpass", "kernel_scharr", "geometry_", "render_", "recursive", "order_rating_datetime", "pixel_rgbcurve", "pixel_basecurve", "pixel_colorbalance", "blend_display_h", "mask_mode", "mask_path", "raster_", "noise_", "style_", "tag_"))) + ["catalog_rules", "collection_grouped", "rule_tag_exact", "sort_color", "sort_path_desc", "pixel_chain", "pixel_velvia", "color_rgb_to_lab", "blend_display_overlay", "mask_sum", "raster_histogram"]


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    sql = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [sql.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
    assert ours == theirs


def test_every_oracle_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 300 and set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
