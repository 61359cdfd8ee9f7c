"""Nodes that are only read, and how often their lines are made and their columns read."""

from pyspark.sql import functions as F

from kinforge.operators.checkpoints import stored
from kinforge.sources import ged

LINES = ["0 HEAD", "1 CHAR UTF-8", "0 @I1@ INDI", "1 NAME A /B/", "2 GIVN A", "a line of its own", "3 NOTE behind it", "1 BIRT", "3 DATE without a second level", "2 PLAC P", "0 @F1@ FAM", "1 HUSB @I1@"]


def _lines(spark, lines, step=1):
    return spark.createDataFrame([("a", i * step, x) for i, x in enumerate(lines)], "file string, no long, line string")


def test_read_nodes_are_the_nodes_with_whole_places(spark):
    for step in (1, 40_000):  # in one range of lines, and over many
        lines = _lines(spark, LINES, step)
        columns = ("file", "rec", F.col("ord").cast("long"), F.col("parent").cast("long"), "level", "pointer", "tag", "value", "rec_tag")
        rows = lambda d: sorted(d.select(*columns).collect(), key=lambda r: r[2])
        read = ged.lines_to_read(lines)
        assert dict(read.dtypes)["ord"] == "bigint" and "path" not in read.columns
        assert rows(read) == rows(ged.lines_to_nodes(lines))
        assert [(r["rec"], r[3] // step if r[3] is not None else None) for r in rows(read)] == [(1, None), (1, 0), (2, None), (2, 2), (2, 3), (2, 4), (2, 4), (2, 2), (2, 4), (2, 7), (3, None), (3, 10)]


def test_lines_before_any_record_have_no_parent(spark):
    read = ged.lines_to_read(_lines(spark, ["1 NOTE x", "2 CONT y", "0 @I1@ INDI"]))
    assert [(r["rec"], r["parent"]) for r in read.orderBy("ord").collect()] == [(0, None), (0, 0), (1, None)]


def test_lines_are_made_once(spark):
    nodes = ged.lines_to_read(_lines(spark, LINES))
    nodes._jdf.queryExecution().toRdd().count()
    assert "ReusedExchange" in nodes._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_read_by_columns(spark):
    kept = stored(ged.lines_to_read(_lines(spark, LINES)))
    plan = kept.where("tag = 'NAME'").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tag:string,value:string>" in plan
    assert kept.count() == len(LINES)
