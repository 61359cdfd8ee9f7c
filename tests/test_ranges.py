"""How the lines of nodes that are only read are made and sorted, over any number of ranges of line numbers."""

import random

from pyspark.sql import functions as F

from kinforge.plans import derived
from kinforge.sources import ged

COLUMNS = ("file", "rec", "cast(ord AS long)", "cast(parent AS long)", "level", "pointer", "tag", "value", "rec_tag")


def _rows(d):
    return sorted(d.selectExpr(*COLUMNS).collect(), key=lambda r: (r[0], r[2]))


def test_records_over_many_ranges_are_those_of_the_whole_file(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for f in "abcdef":
        no = 0
        for _ in range(120):
            level = rng.choice([0, 0, 1, 1, 2, 3, 4, 7, 9, 11, None])
            text = "goes on" if level is None else f"{level} @X{no}@ INDI" if level == 0 else f"{level} T{level} v"
            rows.append((f, no, text))
            no += rng.choice([1, 1, 1, 2, 30])
    lines = spark.createDataFrame(rows, "file string, no long, line string")
    for size in (3, 16, 1 << 16):
        monkeypatch.setattr(ged, "RANGE", size)
        assert _rows(ged.lines_to_read(lines)) == _rows(ged.lines_to_nodes(lines))


def test_sorts_begin_with_numbers(spark):
    lines = spark.createDataFrame([("a", i, f"{i % 3} T") for i in range(30)], "file string, no long, line string")
    plan = ged.lines_to_read(lines)._jdf.queryExecution().executedPlan().toString().splitlines()
    of_lines = [x for x in plan if "Sort [" in x and "no#" in x]
    assert len(of_lines) == 2 and all("Sort [_range#" in x or "Sort [rec#" in x for x in of_lines)


def test_lines_of_a_row_are_compiled_and_shared_out(spark):
    d = spark.range(20).select(F.col("id").alias("k"))
    made = derived._lines(d, *[derived._line(F.col("k") * 100 + i, f"{i} T ", F.when(F.col("k") % (i + 1) == 0, F.col("k"))) for i in range(12)])
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString() and made.rdd.getNumPartitions() > d.rdd.getNumPartitions()
    assert sorted((r["no"], r["line"]) for r in made.collect()) == sorted((k * 100 + i, f"{i} T {k}") for k in range(20) for i in range(12) if k % (i + 1) == 0)
