"""What is asked of each person's record is numbers and flags, so no record is sorted for it."""

from kinforge.operators import privacy
from kinforge.sources import ged

TEXT = ["0 @I1@ INDI", "1 NAME A /B/", "1 BIRT", "2 DATE 1 MAY 1901", "2 DATE ABT 1903", "1 DEAT N", "0 @I2@ INDI", "1 CHR", "2 DATE 1850", "1 DEAT", "2 DATE 3 MAR 1911", "2 DATE 4 MAR 1912", "0 @I3@ INDI", "1 NAME C", "2 GIVN private", "1 DEAT", "2 PLAC", "0 @I4@ INDI", "1 EVEN", "2 TYPE his death", "1 DEAT Y", "2 NOTE", "0 @F1@ FAM", "1 NOTE living"]


def _nodes(spark, read):
    return read(spark.createDataFrame([("a", i, x) for i, x in enumerate(TEXT)], "file string, no long, line string"))


def test_years_are_gathered_without_sorting_records(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        nodes = spark.createDataFrame(_nodes(spark, ged.lines_to_read).collect(), _nodes(spark, ged.lines_to_read).schema)
        plan = privacy.years(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_lives_of_both_kinds_of_nodes(spark):
    want = {"@I1@": (1903, 1901, None, False, False), "@I2@": (1850, None, 1912, True, False), "@I3@": (None, None, None, False, True), "@I4@": (None, None, None, True, False)}
    for read in (ged.lines_to_read, ged.lines_to_nodes):
        got = {r["ptr"]: (r["birth_year"], r["exact_birth"], r["death_year"], r["dead"], r["marked"]) for r in privacy.lives(_nodes(spark, read)).collect()}
        assert got == want
