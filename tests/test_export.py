import json

from pyspark.sql import functions as F

from kinforge.operators import expand, export, graph, increments, tree
from kinforge.sources import ged

SAMPLE = """0 HEAD
0 @I1@ INDI
1 NAME Ana /Kovač/ II
2 _MARNM Novak
1 NAME A /Horvat/
2 TYPE married
1 SEX F
1 CHR
2 DATE 4 FEB 1850
1 BIRT
2 DATE 3 FEB 1850
2 PLAC Ptuj
2 OBJE @M1@
1 DEAT Y
1 NOTE see https://data.matricula-online.eu/sl/slovenia/x/01/?pg=2, twice https://data.matricula-online.eu/sl/slovenia/x/01/?pg=2
1 FAMC @F1@
1 FAMS @F2@
0 @I2@ INDI
1 NAME <private>
1 FAMS @F1@
0 @I3@ INDI
1 NAME Jan /Private/
1 BIRT
2 DATE 1820
1 FAMS @F1@
0 @I4@ INDI
1 NAME Iva /Kovač/
1 BIRT
2 DATE ABT 1845
1 FAMC @F1@
0 @I5@ INDI
1 NAME C /D/
1 TYPE x
1 NAME E /F/
2 TYPE maiden
1 FAMS @F2@
0 @F1@ FAM
1 HUSB @I3@
1 WIFE @I2@
1 CHIL @I1@
1 CHIL @I4@
1 CHIL @I9@
1 MARR
2 DATE 1840
0 @F2@ FAM
1 HUSB @I5@
1 WIFE @I1@
0 @M1@ OBJE
1 FILE https://www.example.org/photo/1
1 FILE https://www.billiongraves.com/grave/2
0 TRLR
"""


def nodes(spark, body=SAMPLE, name="a.ged"):
    return ged.text_to_nodes(spark.createDataFrame([(name, body)], "file string, text string"))


def test_persons(spark, tmp_path):
    p = export.persons(nodes(spark))
    by = {r["id"]: r.asDict(recursive=True) for r in p.collect()}
    assert sorted(by) == ["@I1@", "@I3@", "@I4@", "@I5@"]  # a private person without events is left out
    ana = by["@I1@"]
    assert (ana["name"], ana["surname"], ana["alt_surname"], ana["sex"]) == ("Ana", "Kovač", "Horvat, Novak", "f")
    assert ana["birth"] == {"date": "3 FEB 1850", "place": "Ptuj"} and ana["baptism"] == {"date": "4 FEB 1850", "place": ""} and ana["burial"] is None
    assert [x["id"] for x in ana["parents_list"]] == ["@I3@", "@I2@"] and [x["id"] for x in ana["partners_list"]] == ["@I5@"]
    assert ana["links"] == ["https://data.matricula-online.eu/sl/slovenia/x/01/?pg=2", "https://www.billiongraves.com/grave/2"] and by["@I4@"]["links"] is None
    export.write_json(p, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / "file=a.ged").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["@I1@", "@I3@", "@I4@", "@I5@"] and "links" not in lines[2]


def test_families(spark):
    n = nodes(spark)
    by = {r["id"]: r.asDict(recursive=True) for r in export.families(n).collect()}
    assert by["@F1@"]["marriage"] == {"date": "<private>", "place": ""}
    assert [x["id"] for x in by["@F1@"]["children_list"]] == ["@I4@", "@I1@"]
    assert by["@F2@"]["husband"]["name"] == "C" and [x["id"] for x in by["@F2@"]["wife_parents"]] == ["@I3@", "@I2@"]
    assert export.counts(export.persons(n), export.families(n)).first().asDict() == {"file": "a.ged", "persons_count": 4, "families_count": 2, "links_count": 1}
    assert spark.range(1).select(export.contributor_id(F.lit("ana-KOVAČ"))).first()[0] == "Ana-Kovač"


def test_second_given_names(spark):
    body = "0 @I1@ INDI\n1 NAME A /B/\n2 GIVN Ana\n2 SECG  Marija \n2 SECG X\n0 @I2@ INDI\n1 NAME C /D/\n2 SURN D\n2 SECG Eva\n0 @I3@ INDI\n1 NAME E /F/\n2 SECG\n"
    out = ged.serialize(tree.transform(nodes(spark, body), ["secg_givn"])).first()["text"]
    assert out == "0 @I1@ INDI\n1 NAME A /B/\n2 GIVN Ana Marija\n0 @I2@ INDI\n1 NAME C /D/\n2 GIVN Eva\n2 SURN D\n0 @I3@ INDI\n1 NAME E /F/\n2 SECG\n"


def test_death_placeholders_and_ste(spark):
    body = "0 @I1@ INDI\n1 BIRT\n2 DATE 1980\n1 DEAT\n2 DATE __.__\n2 PLAC ...\n0 @I2@ INDI\n1 DEAT\n2 PLAC Ptuj\n1 BURI\n0 @I3@ INDI\n1 BIRT\n2 DATE 1850\n1 DEAT\n0 @I4@ INDI\n1 DEAT Y\n1 CREM\n2 NOTE x\n0 _STE\n1 A b\n0 @S1@ SOUR\n1 _STE\n2 B c\n1 _STX\n2 _STE\n"
    out = ged.serialize(tree.strip_ste(tree.strip_death_placeholders(nodes(spark, body), 2020))).first()["text"]
    assert out == "0 @I1@ INDI\n1 BIRT\n2 DATE 1980\n0 @I2@ INDI\n1 DEAT\n2 PLAC Ptuj\n0 @I3@ INDI\n1 BIRT\n2 DATE 1850\n1 DEAT\n0 @I4@ INDI\n1 DEAT Y\n1 CREM\n2 NOTE x\n0 @S1@ SOUR\n1 _STX\n2 _STE\n"


def test_expansion(spark):
    n = nodes(spark)
    roots = spark.createDataFrame([("a.ged", "@I1@")], "file string, id string")
    people, families, counts = expand.filtered(n, roots, siblings=True, partners=True)
    assert {r["id"] for r in people.collect()} == {"@I1@", "@I2@", "@I3@", "@I4@", "@I5@"} and {r["id"] for r in families.collect()} == {"@F1@", "@F2@"}
    assert {tuple(r) for r in counts.collect()} == {("a.ged", "@I1@", 5, 2), (None, "TOTAL", 5, 2)}
    only, _, _ = expand.filtered(n, roots)
    assert {r["id"] for r in only.collect()} == {"@I1@", "@I2@", "@I3@"}


def test_kept_records(spark):
    n = nodes(spark)
    some = lambda *ids: spark.createDataFrame([("a.ged", i) for i in ids], "file string, id string")
    left = lambda d: [r["pointer"] for r in d.where("level = 0 and tag in ('INDI', 'FAM')").orderBy("rec").collect()]
    assert left(graph.keep(n, some("@I1@"))) == ["@I1@", "@F1@", "@F2@"]
    only = graph.keep(n, some("@I1@"), some("@F2@"))
    assert left(only) == ["@I1@", "@F2@"] and {r["value"] for r in only.where("tag in ('FAMC', 'FAMS', 'HUSB', 'WIFE')").collect()} == {"@F2@", "@I1@"}


def test_many_roots_at_once_as_one_by_one(spark):
    import random

    rng = random.Random(21)
    lines = []
    for i in range(60):
        lines += [f"0 @I{i}@ INDI"] + [f"1 FAMC @F{i % 23}@"] * (i > 5)
        lines += [f"1 FAMS @F{f}@" for f in range(23) if i in (f, f * 2 + 1)]
    for f in range(23):
        lines += [f"0 @F{f}@ FAM", f"1 HUSB @I{f}@", f"1 WIFE @I{f * 2 + 1}@", *[f"1 CHIL @I{i}@" for i in range(6, 60) if i % 23 == f]]
    n = nodes(spark, "\n".join(lines) + "\n")
    ids = [f"@I{i}@" for i in rng.sample(range(60), 2)] + ["@nobody@"]
    roots = spark.createDataFrame([("a.ged", i) for i in ids], "file string, id string")
    k, none = expand.kin(n), roots.limit(0)
    for how in ({"ancestors": True, "siblings": True}, {"ancestors": False, "descendants": True, "with_related": True, "related_depth": 2, "partners": True}):
        people, families = expand.expanded(k, roots, none, **how)
        got = {(r["root"], r["id"]) for r in people.collect()}, {(r["root"], r["id"]) for r in families.collect()}
        want = set(), set()
        for i in ids:
            for part, found in zip(want, expand.expanded(k, roots.where(F.col("id") == i), none, **how)):
                part |= {(i, r["id"]) for r in found.collect()}
        assert got == want


def test_stale_files(spark):
    files = spark.createDataFrame([("A.ged", 5), ("b.ged", 5), ("c.ged", 5), ("d.ged", 1)], "file string, modified int")
    done = spark.createDataFrame([("a.ged", 4), ("B.ged", 9), ("d.ged", 3)], "file string, finished int")
    assert {r["file"] for r in increments.stale(files, done, ["D.GED"]).collect()} == {"A.ged", "c.ged", "d.ged"}


def test_written_lines(spark, tmp_path):
    ged.write(nodes(spark), str(tmp_path / "out"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "out" / "file=a.ged").glob("*.txt"))) == SAMPLE
