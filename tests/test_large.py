"""Steps whose work or memory has to grow no faster than the input."""

import contextlib
import io

from kinforge.operators import expand, graph, privacy, process
from kinforge.operators.checkpoints import cut
from kinforge.sources import ged


def nodes(spark, text):
    return ged.text_to_nodes(spark.createDataFrame([("f", text)], "file string, text string"))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_years_are_worked_out_within_the_record(spark):
    text = "0 @I1@ INDI\n1 BIRT\n2 DATE 1901\n2 DATE 3 MAR 1902\n1 BAPM\n2 DATE 1899\n1 DEAT\n2 PLAC x\n0 @I2@ INDI\n1 NAME Living /X/\n1 CHR\n2 DATE 1850\n1 DEAT N\n2 DATE 1900\n1 EVEN\n2 TYPE a death\n0 @F1@ FAM\n1 DEAT Y"
    n = spark.createDataFrame(nodes(spark, text).collect(), nodes(spark, text).schema)
    d = privacy.years(n)
    assert "Join" not in plan(d) and plan(d).count("Exchange") <= 2
    assert {tuple(r)[1:] for r in d.collect()} == {(1, 1902, 1901, None, True, False), (2, 1850, None, None, True, True)}


def test_closures_broadcast_nothing(spark, monkeypatch):
    plans = []
    for module in (graph, expand):
        monkeypatch.setattr(module, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    up = spark.createDataFrame([("f", 2, 1), ("f", 3, 2), ("f", 1, 3), ("f", 4, 3)], "file string, child long, parent long")
    people = spark.createDataFrame([("f", i, "X", "P" if i == 1 else None) for i in range(1, 5)], "file string, id long, surname string, place string")
    seeds = spark.createDataFrame([("f", 1)], "file string, id long")
    assert {tuple(r)[1:] for r in graph.closure(up, seeds, "parent", "child", people.where("id = 4").select("file", "id")).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r)[1:] for r in expand.surname_origin(people, up).collect()} == {(1, "P"), (2, "P"), (3, "P"), (4, "P")}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_counted_deletes_write_only_what_they_take(spark, monkeypatch):
    written = []
    monkeypatch.setattr(process, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    text = "0 @I1@ INDI\n1 RACE x\n2 CHAN y\n1 CHAN z\n2 CHAN a\n3 CREA b\n2 CREA c\n1 SOUR @S1@\n2 _STE q\n3 NOTE r\n0 _STE\n1 NOTE s\n2 CREA t\n0 @I2@ INDI\n3 CHAN u\n2 CHAN v"
    names = ("change_date", "indi_race", "create_date", "ste")
    n = nodes(spark, text)
    rest, found = process.counted(n, 1950, strip=names)
    assert {(r["processor"], r["n"]) for r in found.collect()} == {("change_date", 3), ("indi_race", 1), ("create_date", 2), ("ste", 2)}
    assert written and all("path" not in columns for columns in written)
    assert sorted(map(str, rest.collect())) == sorted(map(str, process.run(n, 1950, strip=names).collect()))
