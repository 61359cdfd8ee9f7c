from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators import graph, merge, privacy, relational, tree
from kinforge.sources import ged

SAMPLE = """0 HEAD
1 SOUR ours
2 NAME Tool
2 VERS 1.0
1 CHAR ANSI
0 @I1@ INDI
1 NAME Ana /KOVAČ/
1 SEX F
1 BIRT
2 DATE 3.2.1990
2 ADDR Main street, Ptuj
2 PLAC Ptuj, Slovenia
1 FAMC @F1@
0 @I2@ INDI
1 NAME Jan /Kovač/
1 BIRT
2 DATE okoli 1850
1 DEAT Y
1 FAMS @F1@
0 @I3@ INDI
1 NAME NN
1 _LABL x
0 @F1@ FAM
1 HUSB @I2@
1 CHIL @I1@
1 MARR
2 DATE ?
3 NOTE below
0 TRLR
"""


def nodes(spark, body=SAMPLE, name="a.ged"):
    return ged.text_to_nodes(spark.createDataFrame([(name, body)], "file string, text string"))


def written(n):
    return ged.serialize(n).first()["text"]


def test_round_trip(spark):
    assert written(nodes(spark)) == SAMPLE


def test_parse_of_odd_lines(spark):
    n = nodes(spark, "0 HEAD\n1 NOTE one\nloose text\n0 TRLR\n")
    row = n.where("tag = 'CONC'").first()
    assert (row["value"], row["level"]) == ("loose text", 2)


def test_cleaners(spark):
    out = written(tree.clean(nodes(spark), ["dd_mmm_yyyy", "name_lower", "place_slovenia_rm"]))
    assert "2 DATE 3 FEB 1990" in out and "2 DATE ABT 1850" in out and "2 PLAC Ptuj\n" in out
    assert "NOTE below" not in out and "2 DATE ?" not in out
    assert "Ana /KOVAČ/" in out


def test_address_to_place(spark):
    out = written(tree.transform(nodes(spark), ["addr_to_plac"]))
    assert "2 PLAC Main street, Ptuj, Slovenia" in out and "ADDR" not in out


def test_strip_and_nameless(spark):
    out = written(tree.strip_nameless(tree.strip(nodes(spark), tree.STRIPS["labl"])))
    assert "_LABL" not in out and "@I3@" not in out and "@I1@" in out


def test_rename_with_type(spark):
    out = written(tree.rename(nodes(spark), "MARR", "EVEN", "Union"))
    assert "1 EVEN\n2 TYPE Union\n2 DATE ?" in out


def test_header_and_software(spark):
    n = nodes(spark)
    assert "1 CHAR UTF-8" in written(ged.utf8_header(n))
    assert ged.software(n).first().asDict() == {"file": "a.ged", "name": "Tool", "version": "1.0", "corporation": ""}


def test_people_families_and_graph(spark):
    n = nodes(spark)
    p = {r["ptr"]: r for r in relational.persons(n).collect()}
    assert (p["@I1@"]["given"], p["@I1@"]["surname"], p["@I1@"]["sex"], p["@I1@"]["place"]) == ("Ana", "KOVAČ", "f", "Ptuj, Slovenia")
    f = relational.families(n, relational.persons(n)).first()
    assert (f["husband"], f["wife"]) == ("Jan /Kovač/", None)
    par = graph.parents(graph.edges(n))
    seeds = spark.createDataFrame([("a.ged", "@I1@")], "file string, id string")
    assert {(r["id"], r["depth"]) for r in graph.ancestors(par, seeds).collect()} == {("@I1@", 0), ("@I2@", 1)}


def test_closure_ends_on_a_cycle(spark):
    par = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 1)], "file string, child long, parent long")
    assert graph.ancestors(par, spark.createDataFrame([("f", 1)], "file string, id long")).count() == 3


def test_privacy(spark):
    n = nodes(spark)
    y = privacy.years(n)
    gone = y.where(privacy.born_within(2020))
    out = written(privacy.redact(n, gone))
    assert "1 NAME <private>" in out and "3.2.1990" not in out and "Jan /Kovač/" in out
    assert "1 NAME A. /K./" in written(privacy.redact(n, gone, "initials"))


def test_merge_and_dedupe(spark):
    both = nodes(spark).unionByName(nodes(spark, name="b.ged"))
    out = written(merge.merge(both, ["a.ged", "b.ged"]))
    assert out.count("0 HEAD") == 1 and out.count("0 TRLR") == 1 and "0 @f1_I1@ INDI" in out and "1 HUSB @f2_I2@" in out
    body = "0 @A@ INDI\n1 NAME X /Y/\n1 BIRT\n2 DATE 1900\n0 @B@ INDI\n1 NAME x /y/\n1 BIRT\n2 DATE 1900\n1 FAMS @F@\n0 @F@ FAM\n1 HUSB @B@\n"
    n = nodes(spark, body)
    out = written(merge.dedupe(n, merge.duplicate_persons(relational.persons(n))))
    assert "0 @B@" not in out and "1 HUSB @A@" in out and out.count("1 FAMS @F@") == 1
    assert "1 FAMS @F@\n1 NOTE Merged from duplicate record @B@.\n2 CONT Original data:\n2 CONT 1 NAME x /y/\n2 CONT 1 BIRT\n2 CONT 2 DATE 1900\n0 @F@ FAM" in out


def test_decode():
    assert ged.decode("0 HEAD\n1 NAME Žiga\n".encode("utf-8-sig")) == "0 HEAD\n1 NAME Žiga\n"
    assert "Žiga" in ged.decode("0 HEAD\r\n1 NAME Žiga Šuc\r\n".encode("cp1250"))
    assert ged.decode("0 HEAD\n".encode("utf-16")) == "0 HEAD\n"


def test_scalars(spark):
    d = spark.range(1)
    one = lambda c: d.select(c.alias("x")).first()["x"]
    assert one(text.title_words(F.lit("JEAN-PIERRE O'BRIEN"))) == "Jean-Pierre O'Brien"
    assert one(text.clean_name_placeholder(F.lit("??? /Novak/"))) == "NN /Novak/"
    assert one(text.domain(F.lit("https://a.b.example.org:80/x"))) == "example.org:80"
    assert one(text.place_ends(F.lit("a, b, c"))) == "a, c"
