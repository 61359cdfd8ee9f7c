"""Links of elements, sources with pages, and where they are sent."""

import json

import pytest

from kinforge.functions import records
from kinforge.operators import evidence, export
from kinforge.sources import ged

BOOK = "https://data.matricula-online.eu/sl/slovenia/a/b/"
BODY = f"""0 HEAD
0 @M1@ OBJE
1 FILE photo.jpg
1 FILE {BOOK}MKR-1/?pg=3
0 @M2@ OBJE
1 _ORIG
2 _URL {BOOK}MKR-1/?pg=4
1 FILE {BOOK}MKR-1/?pg=9
0 @M3@ OBJE
1 NOTE {BOOK}MKR-1/?pg=5
0 @S1@ SOUR
1 FILN 12
1 OBJE @M1@
1 OBJE @M2@
1 OBJE @M3@
0 @S2@ SOUR
1 ABBR in {BOOK.replace("https", "http")}MKP-2/?pg=1;
1 FILN 13
1 OBJE @M1@
0 @S3@ SOUR
1 TITL no link
1 OBJE @M1@
0 @I1@ INDI
1 NAME Ana /A/
1 BIRT
2 DATE 1850
2 SOUR @S1@
3 PAGE p. 4, line 7
2 SOUR @S1@
3 PAGE 77
2 SOUR @S1@
1 BIRT
2 SOUR @S2@
1 DEAT
2 NOTE see http://data.matricula-onl
3 CONC ine.eu/sl/slovenia/a/b/MKR-7/?pg=1),
3 CONT then https://www.sistory.si/popisi/x
2 SOUR @S3@
3 DATA
4 WWW https://billiongraves.com/grave/1
3 PAGE https://www.findagrave.com/memorial/2
1 SOUR @S2@
2 PAGE 31
1 OBJE @M3@
1 OBJE @M2@
1 NOTE https://fr.geneanet.org/cemetery/5
2 NOTE https://www.dlib.si/inner
1 OCCU https://www.dlib.si/smith
1 FAMS @F1@
0 @I2@ INDI
1 NAME Bor /B/
1 RESI
2 SOUR https://www.familysearch.org/ark:/1/2
3 PAGE https://www.dlib.si/not
1 BAPM
2 NOTE {BOOK}MKU-1/?pg=1
1 BURI
2 NOTE {BOOK.replace("/sl/", "/en/")}MKU-1/?pg=1
1 FAMS @F1@
1 FAMS @F2@
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
0 @F2@ FAM
1 HUSB @I2@
1 MARR
2 OBJE @M2@
1 NOTE https://data.matricula-online.eu/de/slovenia/a/b/MKR-1/?pg=4
0 TRLR
"""


@pytest.fixture(scope="module")
def nodes(spark):
    return ged.text_to_nodes(spark.createDataFrame([("a.ged", BODY)], "file string, text string")).cache()


def test_media_and_sources(nodes):
    shown = evidence.media(nodes)
    assert {r["value"]: r["url"] for r in shown.collect()} == {"@M1@": BOOK + "MKR-1/?pg=3", "@M2@": BOOK + "MKR-1/?pg=4"}
    known, pages = evidence.sources(nodes, shown)
    assert {(r["value"], r["template"], r["paged"]) for r in known.collect()} == {("@S1@", BOOK + "MKR-1/?pg=3", True), ("@S2@", BOOK + "MKP-2/?pg=1", False)}
    assert {(r["value"], r["page"]) for r in pages.collect()} == {("@S1@", "3"), ("@S1@", "4")}


def test_links_of_persons(nodes):
    by = {r["id"]: r["links"] for r in export.persons(nodes).collect()}
    assert by["@I1@"] == [
        BOOK + "MKR-1/?pg=4", BOOK + "MKR-1/?pg=77", BOOK + "MKR-1/?pg=3", BOOK + "MKR-7/?pg=1", "https://www.sistory.si/popisi/x",
        "https://fr.geneanet.org/cemetery/5", "https://billiongraves.com/grave/1", "https://www.findagrave.com/memorial/2", "https://www.dlib.si/smith",
    ]
    # the register in another language counts once, by its last form; a citation's own link makes its page unread
    assert by["@I2@"] == [BOOK.replace("/sl/", "/en/") + "MKU-1/?pg=1", "https://www.familysearch.org/ark:/1/2"]


def test_links_of_families(nodes):
    by = {r["id"]: r["links"] for r in export.families(nodes).collect()}
    # a marriage register at the wife serves a family without links of its own
    assert by == {"@F1@": [BOOK + "MKP-2/?pg=31"], "@F2@": ["https://data.matricula-online.eu/de/slovenia/a/b/MKR-1/?pg=4"]}


def test_kinds_from_a_cache_send_links_on(spark):
    url = BOOK + "unnamed/?pg=2"
    body = f"0 @I1@ INDI\n1 NAME A /B/\n1 NOTE {url}\n0 @F1@ FAM\n1 HUSB @I1@\n"
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", body)], "file string, text string"))
    cache = spark.createDataFrame([(BOOK + "unnamed/", ["marriage", "death"], False)], "base string, kinds array<string>, broken boolean")
    assert [r["links"] for r in export.persons(n).collect()] == [[url]] and [r["links"] for r in export.families(n).collect()] == [None]
    assert [r["links"] for r in export.persons(n, cache).collect()] == [[url]] and [r["links"] for r in export.families(n, cache).collect()] == [[url]]


def test_order_of_written_records(spark, nodes, tmp_path):
    export.write_json(export.persons(nodes).repartition(3), str(tmp_path / "p"), export.PERSON_ORDER)
    lines = [x for f in sorted((tmp_path / "p" / "file=a.ged").glob("*.json")) for x in f.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == ["@I1@", "@I2@"]


def test_sites(spark):
    yes = ["http://data.matricula-online.eu/a/b/c/d/e", "https://de.geneanet.org/friedhof/1", "https://findagrave.com/cgi-bin/fg.cgi?page=gr&x=1", "https://www.sistory.si/ww1/x", "https://dlib.si/x"]
    no = ["https://data.matricula-online.eu/a/b/c/d/", "https://data.matricula-online.eu/a//b/c/d/e", "https://deu.geneanet.org/friedhof/1", "https://x.findagrave.com/memorial/1", "https://www.findagrave.com/memorial/", "https://sistory.si/ww3", "https://dlib.si/", "ftp://dlib.si/x"]
    d = spark.createDataFrame([(x,) for x in [*yes, *no, "", None]], "url string")
    from pyspark.sql import functions as F

    got = {r["url"]: (r["known"], r["site"]) for r in d.select("url", records.known_links(F.col("url")).alias("known"), records.is_site(F.col("url"), *records.SITES).alias("site")).collect()}
    assert all(got[x] == ([x.replace("http://", "https://")], True) for x in yes)
    assert all(got[x] == ([], False) for x in [*no, "", None])
