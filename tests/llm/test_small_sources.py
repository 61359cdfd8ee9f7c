from pyspark.sql import functions as F

from kinforge.llm import op8_mixing as op8


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 20, "b": 60, "c": 130, "d": 260, "e": 40_000}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items()) if s != "e"] + [(100 + i, " ".join(["w"] * 400), "e") for i in range(100)]
    plan = op8.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["source_size"]: r for r in plan.groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert [got[n]["target"] for n in (20, 60, 130, 260)] == [40, 120, 260, 520]
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got.values())
    assert all(r["taken"] <= 2 * r["size"] for r in plan.collect())
