"""Reach through media records, shared files, and the audit of register links."""

import duckdb
import pytest

import __spark_entry__
from kinforge.operators import media, relational
from kinforge.sources import ged

BOOK = "https://data.matricula-online.eu/sl/a/b/c/d/?pg="
BODY = f"""0 HEAD
0 @I1@ INDI
1 NAME Ana /A/
1 BIRT
2 DATE 1850
2 OBJE @M2@
1 DEAT
2 DATE 1901
1 OBJE @M1@
1 SOUR @S1@
2 NOTE https://below.org/source
1 NOTE @N1@
2 NOTE https://below.org/note
1 NOTE text https://inside.org
1 NOTE see {BOOK[:30]}
2 CONC {BOOK[30:]}5
0 @I2@ INDI
1 NAME Bor /B/
1 OBJE
2 FILE https://inline.org/x
2 NOTE HTTPS://Inline.org/X
1 OBJE @M9@
0 @F1@ FAM
1 HUSB @I2@
2 NOTE https://below.org/husband
1 WIFE @I3@
1 MARR
2 OBJE @M3@
0 @M1@ OBJE
1 FILE https://one.org/1
1 OBJE @M2@
2 NOTE https://below.org/media
0 @M2@ OBJE
1 FILE https://two.org/2
1 BIRT https://two.org/event
1 OBJE @M3@
0 @M3@ OBJE
1 FILE https://three.org/3
1 OBJE @M1@
1 OBJE @I2@
0 @M4@ OBJE
1 FILE HTTPS://One.org/1
0 @S1@ SOUR
1 TITL at {BOOK}7 or {BOOK.upper()}7
0 @N1@ NOTE
1 NOTE {BOOK}8
0 TRLR
"""


@pytest.fixture(scope="module")
def nodes(spark):
    return ged.text_to_nodes(spark.createDataFrame([("a.ged", BODY)], "file string, text string")).cache()


def by_id(nodes, found):
    heads = nodes.where("level = 0").select("file", "rec", "pointer")
    out = {}
    for r in found.join(heads, ["file", "rec"]).collect():
        out.setdefault(r["pointer"], set()).add(r["url"])
    return out


CIRCLE = {"https://one.org/1", "https://two.org/2", "https://two.org/event", "https://three.org/3", "https://inline.org/x", "HTTPS://Inline.org/X"}


def test_chains_and_circles(nodes):
    got = by_id(nodes, media.search(nodes))
    assert got == {"@I1@": CIRCLE | {"https://below.org/note"}, "@I2@": {"https://inline.org/x", "HTTPS://Inline.org/X"}, "@F1@": CIRCLE}


def test_events_left_out_pattern_and_persons(spark, nodes):
    got = by_id(nodes, media.search(nodes, include_events=False))
    assert got == {"@I1@": CIRCLE | {"https://below.org/note"}, "@I2@": {"https://inline.org/x", "HTTPS://Inline.org/X"}}
    assert by_id(nodes, media.search(nodes, "INLINE.org/X")) == {i: {"https://inline.org/x", "HTTPS://Inline.org/X"} for i in ("@I1@", "@I2@", "@F1@")}
    only = nodes.where("pointer = '@I2@'").select("file", "rec")
    assert set(by_id(nodes, media.search(nodes, only=only))) == {"@I2@", "@F1@"}


def test_shared_files(nodes):
    heads = nodes.where("level = 0").select("file", "rec", "pointer")
    got = {(r["url"], r["media"], r["pointer"]) for r in media.shared_files(nodes).join(heads, ["file", "rec"], "left").collect()}
    assert got == {("https://one.org/1", "@M1@", "@I1@"), ("https://one.org/1", "@M4@", None)}


def test_audit(spark, nodes):
    none = spark.createDataFrame([], "file string, url string")
    got = sorted((r["at"], r["url"], r["label"]) for r in media.audit(nodes, none).collect())
    ana = "INDI @I1@ — Ana A (b.1850, d.1901)"
    assert [x[1:] for x in got] == [(BOOK + "7", ana), (BOOK + "8", ana), (BOOK + "5", ana)] or {x[1:] for x in got} == {(BOOK + "7", ana), (BOOK + "8", ana), (BOOK + "5", ana)}
    listed = spark.createDataFrame([("a.ged", BOOK.upper() + "7/"), ("b.ged", BOOK + "8")], "file string, url string")
    assert {r["url"] for r in media.audit(nodes, listed).collect()} == {BOOK + "8", BOOK + "5"}


def test_labels_of_families(spark):
    body = f"0 @I1@ INDI\n1 NAME A /B/\n0 @F1@ FAM\n1 WIFE @I9@\n1 HUSB @I1@\n1 NOTE {BOOK}1\n"
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", body)], "file string, text string"))
    assert [r["label"] for r in media.audit(n, spark.createDataFrame([], "file string, url string")).collect()] == ["FAM  @F1@ — A B / @I9@"]


def test_nothing_to_reach(spark):
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", "0 HEAD\n0 @I1@ INDI\n1 OBJE @I1@\n")], "file string, text string"))
    assert media.search(n).count() == 0 and media.shared_files(n).count() == 0


def test_persons_by_whole_names(spark):
    body = "0 @I1@ INDI\n1 NAME Ana Maria /Kovač/\n1 BIRT\n2 DATE 3 FEB 1850\n0 @I2@ INDI\n1 NAME Ana /KOVAČ/\n1 _STP\n0 @I3@ INDI\n1 NAME Jan /Kovačič/\n"
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", body)], "file string, text string"))
    p = relational.persons(n).cache()
    got = {(r["ptr"], r["spec"]) for r in relational.named_persons(p, ["kovač", "ANA Kovač", "Kovač 1850", "@I3@", "Jan Kovač", "Kovač 1851"]).collect()}
    assert got == {("@I1@", "kovač"), ("@I2@", "kovač"), ("@I2@", "ANA Kovač"), ("@I1@", "Kovač 1850"), ("@I3@", "@I3@")}
    assert [r["id"] for r in relational.one_person(p, "Kovačič").collect()] == ["@I3@"]
    for spec in ("kovač", "nobody", "1850"):
        with pytest.raises(ValueError, match="several|nobody"):
            relational.one_person(p, spec)
    assert [tuple(r) for r in relational.home_persons(n).collect()] == [("a.ged", "@I2@")]


LINES = BODY.splitlines() + ["0 @I4@ INDI", "1 SOUR @S1@", "2 DATA", "3 NOTE https://deep.org/hidden", "1 SOUR text", "2 DATA", "3 NOTE https://deep.org/open", "0 @I5@ INDI", "2 NOTE https://no.org/first-level"]


def test_nodes_without_paths(spark):
    lines = spark.createDataFrame([("a.ged", i, x) for i, x in enumerate(LINES)], "file string, no long, line string")
    read, whole = ged.lines_to_read(lines).cache(), ged.lines_to_nodes(lines).cache()
    assert "path" not in read.columns
    for how in ({}, {"include_events": False}, {"pattern": "INLINE.org/X"}):
        assert by_id(read, media.search(read, **how)) == by_id(whole, media.search(whole, **how))
    got = by_id(read, media.search(read, include_events=False))
    assert got == {"@I1@": CIRCLE | {"https://below.org/note"}, "@I2@": {"https://inline.org/x", "HTTPS://Inline.org/X"}, "@I4@": {"https://deep.org/open"}, "@I5@": {"https://no.org/first-level"}}


def test_links_before_any_record_belong_to_nobody(spark):
    lines = spark.createDataFrame([("a.ged", i, x) for i, x in enumerate(["1 INDI https://before.org/x", "1 OBJE @M1@", "0 @M1@ OBJE", "1 FILE https://one.org/1"])], "file string, no long, line string")
    for nodes in (ged.lines_to_read(lines), ged.lines_to_nodes(lines)):
        assert media.search(nodes).count() == 0


def test_media_urls_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, __spark_entry__.queries()["media_urls"](spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["media_urls"]).fetchall()) and got
