"""What the operators must do with every row, on planted cases."""

import random

from pyspark.sql import functions as F

from lumigrid.llm import langid


def test_unlearned_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    r = random.Random(1)
    junk = [(-1 - i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n)), None) for i, n in enumerate([40, 200, 1000] * 10)]
    kept = {x.doc_id for x in langid.drop_unidentified(docs.unionAll(spark.createDataFrame(junk, docs.schema))).select("doc_id").collect()}
    unlearned, learned = ({i for i, x in truth.items() if (x == "fr") == f} for f in (True, False))
    assert not any(j[0] in kept for j in junk)
    assert len(unlearned & kept) / len(unlearned) < 0.1
    assert len(learned & kept) / len(learned) > 0.99


def test_repeats_add_no_variety():
    encoder = langid.Encoder()
    vector, grams, once = encoder.profile("alpha beta")
    again = encoder.profile(" ".join(["alpha beta"] * 500))
    assert again[1] > 400 * grams and again[2] < 1.2 * once
