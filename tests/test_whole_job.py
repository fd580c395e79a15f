"""Queries that must cover their whole tables."""

import pytest

from lumigrid.queries.catalog import ORACLE_SQL, QUERIES
from tests.conftest import DATA

KEYS = "filename datetime import_timestamp change_timestamp export_timestamp print_timestamp rating id color group path custom title description aspect_ratio".split()


@pytest.mark.parametrize("name", [f"order_{k}{d}" for k in KEYS for d in ("", "_desc")])
def test_orders_cover_every_image(spark, duck, name):
    ours = sorted(map(tuple, QUERIES[name](spark, DATA).collect()))
    assert ours == sorted(duck.sql(ORACLE_SQL[name]).fetchall())
    assert len(ours) == spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey % 29 <> 0").count() > 1000


@pytest.mark.parametrize("name", ["select_film_rolls", "first_after", "facet_attached_tags", "facet_tag_suggestions", "recursive_reachability", "join_orphans"])
def test_whole_tables(spark, duck, name):
    df, sql = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    ours = sorted(map(tuple, df.select(*sql.columns).collect()))
    assert "% 50" not in ORACLE_SQL[name] and "% 64" not in ORACLE_SQL[name]
    assert ours == sorted(sql.fetchall()) and ours
