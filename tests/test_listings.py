import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kinforge.operators import media, merge, privacy, relational
from kinforge.sources import ged, sheets


def tree(spark, body):
    return ged.text_to_nodes(spark.createDataFrame([("a.ged", body)], "file string, text string"))


def lines(nodes):
    return nodes.orderBy("ord").select(F.concat_ws(" ", F.col("level").cast("string"), "pointer", "tag", F.nullif("value", F.lit(""))).alias("l")).toPandas()["l"].tolist()


BODY = "0 @I1@ INDI\n1 NAME Ana Maria /Novak/\n2 GIVN Ana Maria\n3 NOTE n\n2 SURN Novak\n2 TYPE birth\n1 NAME B /C/\n1 SEX F\n2 NOTE s\n1 BIRT\n2 DATE 1850\n1 FAMS @F1@\n0 @I2@ INDI\n1 BURI\n1 NOTE x\n0 @I3@ INDI\n1 NOTE y\n0 @F1@ FAM\n1 DEAT\n"
REST = ["0 @I2@ INDI", "1 BURI", "1 NOTE x"]


@pytest.mark.parametrize(
    ("how", "first", "bare"),
    [
        ("private", ["1 NAME <private>"], ["1 NAME <private>"]),
        ("initials", ["1 NAME A. M. /N./", "2 GIVN A. M.", "2 SURN N."], []),
        ("name", ["1 NAME Ana Maria /Novak/", "2 GIVN Ana Maria", "3 NOTE n", "2 SURN Novak", "2 TYPE birth"], []),
    ],
)
def test_filtered_trees_hide_all_without_a_death(spark, how, first, bare):
    got = lines(privacy.hide_in_filtered(tree(spark, BODY), how))
    assert got == ["0 @I1@ INDI", *first, "1 SEX F", "2 NOTE s", "1 FAMS @F1@", *REST, "0 @I3@ INDI", *bare, "0 @F1@ FAM", "1 DEAT"]


def test_unknown_way(spark):
    with pytest.raises(ValueError, match="unknown"):
        privacy.hide_in_filtered(tree(spark, BODY), "all")


def test_addresses_at_any_level(spark):
    n = tree(spark, "0 @I1@ INDI\n1 RESI\n2 ADDR  Big Street \n1 ADDR Big Street\n2 ADDR big road\n0 @I2@ INDI\n1 ADDR Big lane\n0 @F1@ FAM\n1 ADDR\n2 ADDR Bigger\n0 @R1@ REPO\n1 ADDR Big\n")
    assert {tuple(r)[1:] for r in relational.address_search(n, "BIG").collect()} == {(1, 1, "Big Street"), (1, 2, "big road"), (2, 1, "Big lane"), (3, 1, "Bigger")}
    one = n.where("rec = 2").select("file", "rec")
    assert {r["address"] for r in relational.address_search(n, "", one).collect()} == {"Big lane", "Bigger"}


def test_duplicates_by_the_first_name(spark):
    n = tree(spark, "0 @I2@ INDI\n1 NAME ANA /Novak/\n2 TYPE married\n1 NAME Eva /Kos/\n1 BIRT\n2 DATE 1850\n1 BIRT\n2 DATE 1851\n0 @I1@ INDI\n1 NAME Ana /NOVAK/\n1 BIRT\n2 PLAC x\n2 DATE 1850\n0 @I3@ INDI\n1 NAME Ana /Novak/\n1 BIRT\n1 BIRT\n2 DATE 1850\n0 @I4@ INDI\n")
    assert {tuple(r)[1:] for r in merge.duplicate_persons(merge.first_names(n)).collect()} == {("@I1@", "@I1@"), ("@I2@", "@I1@")}


def test_surnames_without_any_place(spark):
    p = spark.createDataFrame([("f", "1", 1, "A", ""), ("f", "2", 2, "A", "1900"), ("f", "3", 3, "B", None), ("f", "4", 4, "", "1800")], "file string, ptr string, rec long, surname string, birth_date string")
    o = spark.createDataFrame([("f", "1", "here"), ("f", "2", "there"), ("f", "3", "")], "file string, id string, place string")
    assert {tuple(r)[1:] for r in relational.surname_origins(p, o).collect()} == {("A", 2, "there"), ("B", 1, "")}


def test_links_of_records_by_type(spark):
    url = "https://data.matricula-online.eu/sl/a/b/c/d/?pg="
    d = spark.createDataFrame([(url + "1 x", [url + "2", None], [(url + "3",)], 7), (None, None, None, None)], "a string, b array<string>, c array<struct<u:string>>, d int")
    assert {r["url"] for r in media.listed_registers(d).collect()} == {url + "1", url + "2"}
    assert media.listed_registers(d.select("d")).count() == 0


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(*pages):
    """A workbook of sheets, each a dict of row to texts from column A on."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, page in enumerate(pages, 1):
            rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(values) if v is not None) + "</row>" for r, values in page.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_records_of_workbooks(spark, tmp_path):
    names = {1: ["Imena", "Naslov"], 2: ["Ana", "x"]}
    book = {1: ["Zp. št.", "IME  OTROKA", None, "Priimek očeta", "?", "Opombe", "opombe"], 2: ["1", " Ana ", "Anica", "Kos", "Koss", "a", "b"], 3: ["", " "], 5: ["2", None, None, None, None, "c", " "]}
    (tmp_path / "home").mkdir()
    (tmp_path / "home" / "b.xlsx").write_bytes(workbook(names, book, {1: list(sheets.HEADERS), 2: ["9"]}))
    (tmp_path / "c.xlsx").write_bytes(workbook(names, {2: ["zp. st.", "naslov", "opombe"], 3: ["1", "2", "3"]}))
    (tmp_path / "~$b.xlsx").write_bytes(b"")
    cells = sheets.read_workbooks(spark, str(tmp_path))
    got = {(r["file"], r["sheet"], r["row"]): r["fields"] for r in sheets.known_rows(cells).collect()}
    assert got == {
        ("b.xlsx", 2, 2): {"seq": "1", "child_name": "Ana", "child_alt_name": "Anica", "father_surname": "Kos", "father_alt_surname": "Koss", "notes": "b"},
        ("b.xlsx", 2, 5): {"seq": "2", "notes": "c"},
    }
    fixed = sheets.fixed_rows(cells, ["one", "two"], column=2, row=2).where("file = 'b.xlsx'")
    assert [tuple(r) for r in fixed.collect()] == [("b.xlsx", 2, "x", None)]


def test_folders_and_the_latest_file(spark):
    d = spark.createDataFrame([("/in/z/2020.csv",), ("/in/a/2021.csv",), ("/in/1999.csv",)], "path string")
    got = {r["path"]: r["c"] for r in d.withColumn("c", sheets.contributor(F.col("path"), "/in/", "all")).collect()}
    assert got == {"/in/z/2020.csv": "z", "/in/a/2021.csv": "a", "/in/1999.csv": "all"}
    assert [r["path"] for r in sheets.latest(d).collect()] == ["/in/a/2021.csv"] and sheets.latest(d.limit(0)).count() == 0
