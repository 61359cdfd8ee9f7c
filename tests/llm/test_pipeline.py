import random

import pytest

pytest.importorskip("kinforge.llm")
import corpus_pipeline


def test_stages_on_a_small_folder(spark, tmp_path):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item = text(20)
    docs = [(i, text(60), f"s{i % 3}", 0.5) for i in range(60)]
    docs += [(100 + i, text(40) + " you idiot moron scum trash", "s0", 0.5) for i in range(30)]
    docs += [(200, docs[0][1], "s1", 77.0), (201, text(30) + " " + item + " " + text(30), "s1", 0.5), (202, None, None, None), (203, "", "s2", 0.5)]
    labels = [(i, int(i >= 100)) for i in [*range(60), *range(100, 130)]]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = kept.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append(name)
        if name == "toxicity":
            assert kept.columns == columns and kept.where("doc_id between 100 and 129").count() == 0 and kept.where("score = 77").count() == 1
        if name == "near_dedup":
            ids = {r["doc_id"] for r in kept.collect()}
            assert 0 in ids and 200 not in ids and {201, 202, 203} <= ids and kept.columns == columns
        if name == "decontamination":
            assert 201 not in {r["doc_id"] for r in kept.collect()} and kept.columns == columns
        if name == "mixing":
            assert kept.columns == columns and kept.count() > 0
    assert kept.count() > 0 and seen == ["toxicity", "near_dedup", "decontamination", "mixing", "packing"]
