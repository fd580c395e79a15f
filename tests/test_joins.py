import math

import pytest

from lumigrid.operators import cluster, joins


def test_tracks(spark):
    track = spark.createDataFrame([(0, 10.0, 20.0), (100, 10.01, 20.01), (200, 50.0, 80.0)], "t long, lat double, lon double")
    images = spark.createDataFrame([(1, 50), (2, 100), (3, 150), (4, -5), (5, 900)], "id long, t long")
    got = {r.id: r for r in joins.as_of_track(images, track).collect()}
    assert (got[1].lat, got[1].lon, got[1].found) == (pytest.approx(10.005), pytest.approx(20.005), True)
    assert (got[2].lat, got[2].found) == (10.01, True)
    assert (got[4].lat, got[4].found, got[5].lat, got[5].found) == (10.0, False, 50.0, False)
    a, b = map(math.radians, (10.01, 50.0))
    o = math.radians(80.0 - 20.01)
    x, y = math.cos(b) * math.cos(o), math.cos(b) * math.sin(o)
    middle = math.degrees(math.atan2(math.sin(a) + math.sin(b), math.hypot(math.cos(a) + x, y)))
    assert got[3].lat == pytest.approx(middle) and got[3].found
    assert joins.as_of_track(images.limit(0), track).count() == 0
    assert all(r.lat is None and not r.found for r in joins.as_of_track(images, track.limit(0)).collect())


def test_intervals(spark):
    facts = spark.createDataFrame([(i, float(i * 7 % 1000)) for i in range(300)], "id long, v double")
    rows = [(k, lo, lo + w) for k, (lo, w) in enumerate([(0.0, 1.0), (10.0, 0.0), (-50.0, 5000.0), (400.0, 30.0), (5.0, 100_000.0), (9.0, -1.0)])]
    spans = spark.createDataFrame(rows, "k long, low double, high double")
    got = sorted((r.id, r.k) for r in joins.interval_join(facts, "v", spans, "low", "high", 10.0, most_buckets=8).collect())
    assert got == sorted((i, k) for i in range(300) for k, lo, hi in rows if lo <= float(i * 7 % 1000) <= hi)
    assert joins.interval_join(facts, "v", spans.limit(0), "low", "high", 10.0).count() == 0


def test_polygons(spark):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (5.0, 5.0)]
    places = spark.createDataFrame([(1, 2, 5.0, 5.0, 6.0, 6.0, ring)], "tagid long, type int, longitude double, latitude double, delta1 double, delta2 double, polygons array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(1, 5.0, 8.0), (2, 1.0, 5.0), (3, 9.0, 5.0), (4, 20.0, 5.0), (5, None, 1.0)], "id long, longitude double, latitude double")
    assert {r.id for r in joins.locate(points, places).collect()} == {1, 3}


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 5)], "imgid long, overlay_id long")
    got = {(r.start, r.node) for r in joins.reachable(edges, edges.where("imgid in (1, 4)").select("imgid")).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (4, 5)}
    assert joins.would_cycle(edges.where("imgid = 1"), 2, 1) and not joins.would_cycle(edges.where("imgid = 1"), 3, 4)


def test_clusters(spark):
    points = [(i, 0.01 * i, 0.0) for i in range(40)] + [(100, 5.0, 5.0), (101, None, 1.0)] + [(200 + i, 9.0, 0.01 * i) for i in range(10)]
    got = {r.id: r.cluster for r in cluster.grid_dbscan(spark.createDataFrame(points, "id long, longitude double, latitude double"), 0.05, 3).collect()}
    assert len({got[i] for i in range(40)}) == 1 and got[0] and got[100] is None and 101 not in got
    assert len({got[200 + i] for i in range(10)}) == 1 and got[200] != got[0]


def test_track_of_one_crowded_day(spark):
    """Time must not grow with the square of a span's rows: frames that run to the end do."""
    rows = spark.range(1000).selectExpr("id", "id * 1000 AS t", "cast(id % 50 as double) AS lat", "cast(id % 70 as double) AS lon")
    out = joins.as_of_track(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    got = {r.id: r for r in out.collect()}
    assert len(got) == 500 and sum(r.found for r in got.values()) == 499 and got[999].lat == 998 % 50
