import json

import pytest
from pyspark.sql import functions as F

from kinforge.functions import records
from kinforge.operators import labels, links, process
from kinforge.sources import ged

BODY = """0 @I1@ INDI
1 NAME Ana Maria /Kovač/
2 GIVN Ana Maria
2 SURN Kovač
2 NOTE secret
1 BIRT
2 DATE 3 FEB 1990
1 FAMS @F1@
2 NOTE link
0 @I2@ INDI
1 NAME Jan /Kovač/
1 BIRT
2 DATE ABT 1850
1 DEAT
2 DATE 1901
1 FAMS @F1@
0 @I3@ INDI
1 BIRT
2 DATE 2001
1 PRIV
0 @I4@ INDI
1 NAME //
2 GIVN Eva
1 EVEN
2 TYPE Death notice
1 CHAN
2 DATE 1 JAN 2020
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 MARR
2 DATE 1875
2 PLAC Ptuj
2 NOTE kept
0 @F2@ FAM
0 @S1@ SOUR
"""


@pytest.fixture(scope="module")
def nodes(spark):
    return ged.text_to_nodes(spark.createDataFrame([("a.ged", BODY)], "file string, text string")).cache()


def written(n):
    return ged.serialize(n).first()["text"]


def test_labels(nodes):
    assert {r["ptr"]: r["label"] for r in labels.person_labels(nodes).collect()} == {"@I1@": "Ana Maria Kovač (b.1990)", "@I2@": "Jan Kovač (b.1850 d.1901)", "@I3@": "? (b.2001)", "@I4@": "Eva"}
    assert {r["label"] for r in labels.family_labels(nodes).collect()} == {"FAM  @F1@ — Jan Kovač (b.1850 d.1901) + Ana Maria Kovač (b.1990)", "FAM  @F2@ — ?"}
    assert {"INDI @I4@ — Eva", "FAM  @F2@", "SOUR @S1@"} <= {r["label"] for r in labels.record_labels(nodes).collect()}


def test_initials_preset(nodes):
    out = written(process.run(nodes, 2026, "mft_public", strip=("change_date",)))
    assert "1 NAME A. M. /K./\n2 GIVN A. M.\n2 SURN K.\n1 FAMS @F1@\n2 NOTE link\n0 @I2@" in out
    assert "secret" not in out and "1 NAME Jan /Kovač/" in out and "2 GIVN Eva" in out
    assert "0 @I3@ INDI\n1 NAME\n0 @I4@" in out  # hidden before deletes, so its mark is gone
    assert "2 DATE 1875" not in out and "Ptuj" not in out and "2 NOTE kept" in out


def test_private_gains_a_name_and_living_go(nodes):
    out = written(process.hide(nodes, "born75y_private", 2026))
    assert "0 @I3@ INDI\n1 NAME <private>\n0 @I4@" in out and "1 NAME <private>\n1 FAMS @F1@\n2 NOTE link" in out
    out = written(process.run(nodes, 2026, strip=("living",)))
    assert "@I1@ INDI" not in out and "@I3@" not in out and "@F1@ FAM" not in out and "@F2@ FAM" in out and "@I4@ INDI" in out
    with pytest.raises(ValueError):
        process.run(nodes, 2026, strip=("nothing",))


def test_kinds_of_links(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"https://x.org/a": "death", "https://x.org/b": ["birth", "death"], "https://x.org/c": "broken", "https://x.org/d": "unknown"}))
    cache = links.read_cache(spark, str(tmp_path / "c.json"))
    urls = ["https://x.org/a?pg=3", "https://x.org/b", "https://x.org/c", "https://x.org/d", "https://x.org/mkp/1", "https://www.familysearch.org/ark:/MKU", None]
    found = {r["url"]: r["kinds"] for r in links.typed(spark.createDataFrame([(u,) for u in urls], "url string"), cache).collect()}
    assert found == dict(zip(urls, [["death"], ["birth", "death"], [], [], ["marriage"], [], []], strict=True))
    pages = spark.createDataFrame([("u?pg=1", 200, "<title>Taufbuch</title><h1>Trauungen</h1><a href='x'>Sterbebuch</a>"), ("v", 200, "<p>Deaths</p><a href='x'>taufen</a>"), ("w", 404, None), ("z", 500, "")], "url string, status int, html string")
    assert {r["base"]: (r["kinds"], r["broken"]) for r in links.cache_from_pages(pages).collect()} == {"u": (["birth", "marriage"], False), "v": (["death"], False), "w": ([], True)}


def test_scalars(spark):
    cases = [("Kovačič", "Kovačič_Martin"), ("Kovačič-B", "Kovačič_Brane"), ("Kovačič-M", "Kovačič_Brane"), ("", "x"), ("B-Kov", "Kovačič_Brane"), ("-", "x")]
    d = spark.createDataFrame(cases, "f string, p string").select(records.names_folder(F.col("f"), F.col("p")).alias("x"))
    assert [r["x"] for r in d.collect()] == [True, True, False, True, False, False]
    one = spark.range(1).select(
        records.with_page(F.lit("https://x/?pg=1"), F.lit(7)).alias("a"), records.first_link(F.lit("see https://www.findagrave.com/memorial/5/x, and more"), "geneanet", "findagrave").alias("b"),
        labels.person_line(F.lit("Ana"), F.lit(""), F.lit("1850"), F.lit(None).cast("string"), F.lit("Ptuj"), F.lit("@I1@")).alias("c"), labels.person_line(*[F.lit("")] * 5).alias("d"),
    ).first()
    assert tuple(one) == ("https://x/?pg=7", "https://www.findagrave.com/memorial/5/x", "@I1@ Ana *1850 Ptuj", "?")


def test_counts_of_a_run_and_their_summary(nodes):
    out, found = process.counted(nodes, 2020, clean=("dd_mmm_yyyy", "name_lower"), transform=("living100y_private",), strip=("change_date", "create_date", "priv"))
    assert ged.serialize(out).first()["text"] == ged.serialize(process.run(nodes, 2020, clean=("dd_mmm_yyyy", "name_lower"), transform=("living100y_private",), strip=("change_date", "create_date", "priv"))).first()["text"]
    by = {r["processor"]: r["n"] for r in found.collect()}
    assert by["living100y_private"] == 2 and "create_date" not in by
    table = process.summary(nodes, found)
    assert table.columns == ["file", *[r["processor"] for r in found.orderBy("place").collect()]]
    assert {r["file"]: r["living100y_private"] for r in table.collect()} == {"a": 2, "TOTAL": 2}
    assert process.summary(nodes, found.where("false")).collect()[0].asDict() == {"file": "a"}
