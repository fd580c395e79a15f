"""The corpus pipeline, stage by stage, on a small table with planted cases."""

import collections

import corpus_pipeline
from lumigrid.llm.common import materialize
from tests.llm.test_operators import SCHEMA, brute_groups, documents, lower


def test_stages(spark):
    rows = [r for r in documents() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {r[0]: r[1] for r in rows}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "test")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [f.split(" ")[0] for f in SCHEMA.split(", ")]
    kept = {r.doc_id for r in out["language ID"]}
    assert all(any(c.isalpha() for c in texts[i] or "") for i in kept)
    assert {i for i, t in texts.items() if t and len(t) < 200 and any(c.isalpha() for c in t)} <= kept
    assert collections.Counter(lower(r.text) for r in out["exact dedup"]) == collections.Counter({lower(texts[i]): 1 for i in kept})
    groups = brute_groups([(r.doc_id, r.text) for r in out["exact dedup"]], 5, corpus_pipeline.Fraction(4, 5))
    assert {r.doc_id for r in out["near dedup"]} == {i for i, _, c in groups if i == c}
    assert {r.doc_id for r in out["packing"]} == {r.doc_id for r in out["near dedup"]}


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "packing"]


def test_stages_on_odd_tables(spark):
    """Nothing at all, only what no stage keeps, and null ids among copies."""
    letters = "alpha beta gamma delta epsilon zeta eta theta"
    odd = {
        "empty": ([], 0),
        "no letters": ([(1, None, None, None, None, None), (2, "", "en", None, None, None), (3, " 12 ", None, "x", "x", 1)], 0),
        "null ids": ([(None, letters, "en", None, None, None), (5, letters.upper(), "en", None, None, None), (None, letters + " iota", None, None, None, None), (None, letters + " iota", None, None, None, None)], 2),
    }
    for rows, left in odd.values():
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, ""), "test")
            if name == "near dedup":
                assert docs.count() == left
        assert docs.agg({"offset": "count"}).first()[0] >= left and (docs.count() > 0) == (left > 0)
