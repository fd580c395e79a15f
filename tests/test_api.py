import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.api import Engine, EngineError, Library
from lumigrid.plans.catalog import Catalog
from lumigrid.plans.collection import Collection, Rule, Sort, deserialize, serialize
from lumigrid.plans.layers import Plan
from lumigrid.plans.roles import catalog
from lumigrid.sources import images
from lumigrid.streaming import windows
from tests.conftest import DATA


def test_engine(spark, tmp_path):
    y, x = np.indices((12, 10))
    a = np.stack([x / 9, y / 11, (x + y) / 20], axis=-1)
    (tmp_path / "a.pfm").write_bytes(images.write_pfm(a))
    engine = Engine(spark)
    image = engine.load(str(tmp_path / "a.pfm"))
    assert (image.height, image.width) == (12, 10)
    pipe = engine.pipeline()
    for s in pipe.stages:
        s.enabled = False
    out = images.decode("x.png", engine.export(image, pipe, "png", bits=16))
    srgb = np.where(a <= 0.0031308, 12.92 * a, 1.055 * np.maximum(a, 0.0031308) ** (1 / 2.4) - 0.055)
    assert np.abs(out - srgb).max() < 1e-3
    engine.register_point("halve", lambda p: p.let(c0="c0 / 2"))
    assert "halve" in engine.modules()
    for call, code in ((lambda: engine.render(image, pipe, -1), -11), (lambda: engine.export(image, pipe, "avif"), -12), (lambda: engine.load_history("{"), -5), (lambda: engine.load_xmp("<"), -5)):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code and engine.last_error
    pipe.enable("sharpen")
    again, unknown = engine.load_xmp(engine.save_xmp(pipe).replace("sharpen", "sharpen", 1))
    assert again.is_enabled("sharpen") and not unknown
    assert Plan().layers == ()


def test_library(spark):
    lib = Library(catalog(spark, DATA))
    seen = []
    lib.events.register("selection-changed", "test", lambda *a: seen.append(a))
    chosen = spark.createDataFrame([(1,), (2,), (2,)], "imgid long")
    lib.select(chosen)
    lib.rate(chosen, 4)
    lib.attach_tag(chosen, 5)
    lib.move(chosen, 3)
    rows = lib.catalog["images"].where("id in (1, 2)").collect()
    assert [r.flags & 15 for r in rows] == [4, 4] and {r.film_id for r in rows} == {3} and seen
    assert lib.catalog["tagged_images"].where("tagid = 5 and imgid in (1, 2)").count() == 2
    before = lib.catalog["images"].count()
    lib.duplicate(chosen)
    lib.delete(spark.createDataFrame([(3,)], "imgid long"))
    assert lib.catalog["images"].count() == before + 1
    lib.events.destroy("selection-changed", "test")
    assert not lib.events.query("selection-changed", "test")


def test_rules_survive_text():
    rules = (Rule("metadata:2", "a:c", "OR"), Rule("iso", ">100", "AND NOT", True))
    assert deserialize(serialize(rules)) == rules
    assert deserialize("garbage") == ()


def test_nothing_parses_to_everything(spark):
    cat = catalog(spark, DATA)
    every = Collection().count(cat)
    for prop in ("iso", "aperture", "exposure", "day", "rating", "focal_length", "history", "local_copy"):
        assert Collection(rules=(Rule(prop, "¿?"),)).count(cat) == every, prop
    assert Collection(rules=(Rule("iso", "400"), Rule("iso", "", "OR"))).count(cat) == every
    assert Collection(rules=(Rule("iso", "400", "AND NOT"),)).count(cat) == every - Collection(rules=(Rule("iso", "400"),)).count(cat)
    assert Collection(rules=(Rule("day", "<>1996"),), strict_compat=True).count(cat) == 0
    with pytest.raises(ValueError):
        Collection(rules=(Rule("nonsense", "1"),)).count(cat)
    empty = Catalog({k: v.limit(0) for k, v in cat.tables.items()})
    assert Collection(rules=(Rule("tag", "x*"), Rule("color", "0x3", "OR"))).count(empty) == 0


def test_plans(spark):
    """Semi joins for sets, top-k for pages, filters down to the scan."""
    cat = catalog(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(Collection(rules=(Rule("tag", "Brand#1*"),)).where(cat))
    assert "LeftSemi" in one and "CartesianProduct" not in one and "NestedLoop" not in one
    assert "TakeOrderedAndProject" in plan(Collection(sorts=(Sort("datetime"),), limit=10).query(cat))
    scan = plan(spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey > 5").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in scan


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.stream_of(spark, str(tmp_path / "in"), events.schema, most_files=1)
    got = {}

    def sink(df, number):
        for r in df.collect():
            got[(r.window.start, r.event_type)] = (r.n, round(r.total, 4))

    windows.run_available(windows.tumbling(stream, "1 hour", "365 days"), str(tmp_path / "cp"), sink).awaitTermination()
    want = {(r.window.start, r.event_type): (r.n, round(r.total, 4)) for r in windows.tumbling(events, "1 hour").collect()}
    assert got == want
    assert windows.sliding(events, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * events.count()
