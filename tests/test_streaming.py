"""Files that arrive in batches, change, and lose their records."""

import os

from pyspark.sql import functions as F

from kinforge.operators import increments
from kinforge.sources import ged
from kinforge.streaming import files


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at, at))


def names(texts):
    n = ged.text_to_nodes(texts)
    return n.where("tag = 'NAME'").select("file", "value")


def test_arrivals_changes_and_emptied_files(spark, tmp_path):
    folder, out, state, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "seen")
    folder.mkdir()
    asked = []

    def convert(texts):
        asked.append(sorted(r["file"] for r in texts.select("file").collect()))
        return names(texts)

    def rows():
        return sorted((r["file"], r["value"]) for r in spark.read.parquet(out).collect())

    def up():
        files.keep_up(spark, str(folder), convert, out, state, seen)

    put(folder, "a.ged", "0 @I1@ INDI\n1 NAME Ana /A/\n", 1_600_000_000)
    put(folder, "b c.GED", "0 @I1@ INDI\n1 NAME Bor /B/\n1 NAME Bo /B/\n", 1_600_000_001)
    put(folder, "note.txt", "0 @I1@ INDI\n1 NAME X\n", 1_600_000_001)
    up()
    assert rows() == [("a.ged", "Ana /A/"), ("b c.GED", "Bo /B/"), ("b c.GED", "Bor /B/")]
    put(folder, "d.ged", "0 @I1@ INDI\n1 NAME Dan /D/\n", 1_600_000_002)
    up()
    up()
    assert asked == [["a.ged", "b c.GED"], ["d.ged"]] and len(rows()) == 4
    put(folder, "a.ged", "0 @I1@ INDI\n1 NAME Ana /New/\n", 1_600_000_010)
    put(folder, "b c.GED", "0 HEAD\n", 1_600_000_011)
    files.catch_up(spark, str(folder), convert, out, state)
    assert asked[2:] == [["a.ged", "b c.GED"]] and rows() == [("a.ged", "Ana /New/"), ("d.ged", "Dan /D/")]
    files.catch_up(spark, str(folder), convert, out, state)
    assert len(asked) == 3
    files.catch_up(spark, str(folder), convert, out, state, forced=["D.GED"])
    assert asked[3:] == [["d.ged"]] and rows() == [("a.ged", "Ana /New/"), ("d.ged", "Dan /D/")]


def test_a_batch_done_again_leaves_the_same(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    d = spark.createDataFrame([("a.ged", 5, "0 @I1@ INDI\n1 NAME A\n")], "file string, modified int, text string").withColumn("modified", F.timestamp_seconds("modified"))
    files.apply(d, names, out, state)
    files.apply(d, names, out, str(tmp_path / "lost state"))
    assert [r["value"] for r in spark.read.parquet(out).collect()] == ["A"]


def test_groups_of_inputs_and_outputs(spark):
    inputs = spark.createDataFrame([("x", 5), ("x", 9), ("y", 5), ("z", 5), ("w", 5)], "folder string, modified int")
    outputs = spark.createDataFrame([("x", 8), ("x", 20), ("y", 5), ("z", 4)], "folder string, modified int")
    assert {r["folder"] for r in increments.stale_groups(inputs, outputs).collect()} == {"x", "z", "w"}
