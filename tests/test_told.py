"""What records tell of themselves while their nodes lie together, and how often their nodes are dealt out."""

from pyspark.sql import functions as F

from kinforge.operators import evidence, export
from kinforge.operators.checkpoints import stored
from kinforge.sources import ged

TEXT = ["0 @I1@ INDI", "1 NAME A /B/", "2 TYPE maiden", "1 NAME C /D/", "1 BIRT", "2 DATE 1800", "1 NOTE see htt", "2 CONC ps://www.findagrave.com/memorial/7", "1 FAMS @F1@", "0 @I2@ INDI", "1 NAME E /F/", "1 FAMC @F1@", "0 @F1@ FAM", "1 HUSB @I9@", "1 HUSB @I1@", "1 DIV", "2 DATE 1840", "1 MARR", "2 PLAC P", "1 MARR", "2 DATE 1830", "1 CHIL @I2@", "1 NOTE https://www.dlib.si/x/3", "0 @F2@ FAM", "1 WIFE @I2@", "1 MARR", "2 DATE 1850", "2 DATE 1851"]


def _lines(spark, lines=TEXT):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "file string, no long, line string")


def _told(spark):
    return stored(ged.lines_to_read(_lines(spark), evidence.linked(), export.told_of_families()))


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_families_are_told_at_their_heads(spark):
    told, plain = _told(spark), ged.lines_to_nodes(_lines(spark))
    assert "Exchange" not in _plan(export._families(told)) and "Exchange" in _plan(export._families(plain))
    rows = lambda n: [r.asDict(True) for r in export.families(n).drop("ord").orderBy("id").collect()]
    got = rows(told)
    assert got == rows(plain)
    assert [(r["husband"] and r["husband"]["id"], r["marriage"]) for r in got] == [("@I1@", {"date": "", "place": "P"}), (None, {"date": "1851", "place": ""})]
    assert [r["links"] for r in got] == [["https://www.dlib.si/x/3"], None] and got[0]["husband"]["alt_surname"] == "B"


def test_only_records_with_links_are_searched(spark):
    told = _told(spark)
    assert {(r["rec"], r["linked"]) for r in told.collect()} == {(1, True), (2, False), (3, True), (4, False)}
    rows = lambda n: sorted(tuple(r) for r in evidence.cited(n).select("rec", F.col("at").cast("long"), "url").collect())
    assert rows(told) == rows(ged.lines_to_nodes(_lines(spark))) == [(1, 6, "https://www.findagrave.com/memorial/7"), (3, 22, "https://www.dlib.si/x/3")]


def test_persons_are_dealt_out_once(spark):
    plan = _plan(export.facts(_told(spark)))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_lines_in_one_reading(spark):
    odd = ["0 HEAD\r", "1 NOTE\tx", "5", "1 NOTE  two ", "0 @a\nb@ INDI", "1 NAME", " 1  @x@  SEX M", "1 NOTE a\nb", "12 CONT $1 \\2", "no level", "1 NAME  "]
    d = _lines(spark, odd).select(ged._parts().alias("p"), F.array(*[F.regexp_extract("line", ged.LINE, i) for i in range(1, 5)]).alias("w"))
    for r in d.collect():
        assert r["p"] == r["w"] if r["w"][0] else len(r["p"]) != 4 or not r["p"][0]
