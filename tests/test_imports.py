"""The importers' queries against their SQL, and name and date forms one by one."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from kinforge.functions import records
from kinforge.plans import imports

DATA = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(imports.SQL))
def test_against_sql(spark, name):
    got = imports.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(imports.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert norm(got.select(*columns).collect()) == norm(want.fetchall())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("(Janez", "Janez"), ("(Janez Nepomuk)", "Janez Nepomuk"), ("(Fere, Flere)", "Fere (Flere)"), ("Janez  (Ivan)", "Janez (Ivan)"), ("", ""), (None, "")])
def test_name_variants(spark, raw, want):
    assert one(spark, records.name_variants(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("Kos Ana", ("Kos", "Ana", "", "", "")), ("Kos", ("Kos", "", "", "", "")), ("", ("", "", "", "", "")), ("Kos (Koss) Ana", ("Kos", "Ana", "Koss", "", "")), ("Kos (Ana)", ("Kos", "(Ana)", "", "", "")), ("Kos V. dr. Ana Marija", ("Kos", "Ana Marija", "", "dr.", "V."))])
def test_name_tokens(spark, raw, want):
    assert tuple(one(spark, records.name_tokens(F.lit(raw)))) == want


@pytest.mark.parametrize("raw,want", [("roj. Bizjak", ("Bizjak", "")), ("vulgo X; r. Rožič, kovač", ("Rožič", "vulgo X; , kovač")), ("brez", ("", "brez")), (None, ("", ""))])
def test_maiden_name(spark, raw, want):
    assert tuple(one(spark, records.maiden_name(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize("raw,want", [("Golac, 1890", (("1890", "Golac"), ("", ""))), ("?", (("", ""), ("", ""))), ("1890-1916, Galicija", (("1890", ""), ("1916", "Galicija")))])
def test_life(spark, raw, want):
    got = one(spark, records.life(F.lit(raw)))
    assert (tuple(got["birth"]), tuple(got["death"])) == want


def test_missing_columns_and_empty_tables(spark):
    from kinforge.operators import importers

    rows = spark.createDataFrame([(1, None)], "row long, prenom string")
    assert importers.grave_persons(rows).count() == 0
    assert importers.birth_records(spark.createDataFrame([], "seq long")).count() == 0
