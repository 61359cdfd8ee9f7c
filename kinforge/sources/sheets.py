"""Workbook and CSV inputs: the archive's XML is read with the standard library, one task for each file."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import text as texts

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


#: fixed values: the headers of register workbooks, in lower case without accents, and what their columns hold
HEADERS = {
    "zp. st.": "seq", "zupnija": "parish", "datum rojstva": "birth_date", "datum krsta": "baptism_date", "datum poroke": "marriage_date", "naslov": "address",
    "ime otroka": "child_name", "ime oceta": "father_name", "priimek oceta": "father_surname", "alt. priimek oceta": "father_alt_surname",
    "ime matere": "mother_name", "priimek matere": "mother_surname", "alt. priimek matere": "mother_alt_surname",
    "ime zenina": "groom_name", "priimek zenina": "groom_surname", "alt. priimek zenina": "groom_alt_surname",
    "ime neveste": "bride_name", "priimek neveste": "bride_surname", "alt. priimek neveste": "bride_alt_surname",
    "url naslov": "url", "opombe": "notes", "interpret": "interpreter",
}
#: fixed values: what a column without a known header holds behind one of these
BEHIND = {"child_name": "child_alt_name", "father_surname": "father_alt_surname", "mother_surname": "mother_alt_surname"}
#: columns with known headers that a sheet of records has at least
KNOWN = 3


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def sheet_rows(raw: bytes) -> Iterator[tuple[int, int, dict[int, str]]]:
    """(sheet, row, {column: text}) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(NS + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(NS + "si")]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for s, name in enumerate(names, 1):
            for r in ElementTree.fromstring(z.read(name)).iter(NS + "row"):
                cells = {}
                for c in r.iter(NS + "c"):
                    v = c.find(NS + "v")
                    text = "".join(t.text or "" for t in c.iter(NS + "t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "") or ""
                    cells[column_number(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text else text
                if any(x.strip() for x in cells.values()):
                    yield s, int(r.get("r")), cells


def normalize_header(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.strip().lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", plain)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``file, sheet, row, cells`` (column number to text); blank rows and lock files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(f, s, r, list(c.items())) for f, raw in zip(d["file"], d["content"]) for s, r, c in sheet_rows(raw)]
            yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    raw = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content").where(~F.col("file").startswith("~$"))
    cells = raw.mapInPandas(run, "file string, sheet int, row int, cells array<struct<c:int,v:string>>")
    return cells.withColumn("cells", F.map_from_entries("cells"))


def read_grave_csv(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"')
    return d.where(F.concat_ws("", *d.columns) != "")


def header(c: Column) -> Column:
    """A header as it is looked up: lower case, without accents, single spaces."""
    return F.regexp_replace(texts.fold(F.lower(texts.strip(c))), r"(?U)\s+", " ")


def known_rows(cells: DataFrame, headers: dict[str, str] = HEADERS, behind: dict[str, str] = BEHIND) -> DataFrame:
    """``file, sheet, row, fields`` (field to text) of each file's first sheet with enough known headers in row 1.

    A column with an unknown header right of some fields holds what ``behind`` says. Blank cells are
    left out, and rows without any other; of two columns of one field the right one counts.
    """
    lookup = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    beside = F.create_map(*[F.lit(x) for kv in behind.items() for x in kv])
    named = F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].alias("c"), F.element_at(lookup, header(e["value"])).alias("field")))
    top = cells.where("row = 1").select("file", "sheet", F.filter(named, lambda e: e["field"].isNotNull()).alias("own"))
    next_to = F.transform(F.col("own"), lambda e: F.struct((e["c"] + 1).alias("c"), F.element_at(beside, e["field"]).alias("field")))
    free = F.filter(next_to, lambda e: e["field"].isNotNull() & ~F.exists("own", lambda o: o["c"] == e["c"]))
    top = top.select("file", "sheet", F.concat("own", free).alias("columns")).where(F.size("columns") >= KNOWN)
    sheets = top.groupBy("file").agg(F.min("sheet").alias("sheet"), F.min_by("columns", "sheet").alias("columns"))
    rows = cells.where("row > 1").join(sheets, ["file", "sheet"])
    values = F.transform(F.col("columns"), lambda e: F.struct(e["c"].alias("c"), e["field"].alias("field"), texts.strip(F.element_at("cells", e["c"])).alias("text")))
    rows = rows.select("file", "sheet", "row", F.filter(values, lambda e: F.coalesce(e["text"], F.lit("")) != "").alias("found"))
    last = F.filter("found", lambda e: ~F.exists("found", lambda o: (o["field"] == e["field"]) & (o["c"] > e["c"])))
    fields = F.map_from_entries(F.transform(last, lambda e: F.struct(e["field"], e["text"])))
    return rows.where(F.size("found") > 0).select("file", "sheet", "row", fields.alias("fields"))


def fixed_rows(cells: DataFrame, names: list[str], column: int = 2, row: int = 8) -> DataFrame:
    """``file, row`` and the named columns of each file's first sheet, from a column and a row on; missing cells are null."""
    d = cells.where((F.col("sheet") == 1) & (F.col("row") >= row))
    return d.select("file", "row", *[F.try_element_at("cells", F.lit(column + i)).alias(n) for i, n in enumerate(names)])


def contributor(path: Column, root: str, alone: str) -> Column:
    """The first folder below the root on the way to a file, or ``alone`` for a file right in it."""
    inside = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "/")
    return F.when(F.size(inside) > 1, inside[0]).otherwise(alone)


def latest(files: DataFrame) -> DataFrame:
    """The row (path) whose file name is last by its characters; none of none."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy().agg(F.max_by(F.struct(*files.columns), F.struct(name, F.col("path"))).alias("r")).where("r is not null").select("r.*")
