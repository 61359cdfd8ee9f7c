import json
import unicodedata

from kinforge.operators import outputs


def test_every_text_is_composed(spark):
    loose = unicodedata.normalize("NFD", "Žiga Čeh")
    row = (1, loose, [loose, None], {"k": loose}, {"a": [(loose, 2)], "b": None}, [3])
    d = spark.createDataFrame([row, (2, None, None, None, None, None)], "id int, t string, l array<string>, m map<string,string>, s struct<a:array<struct<x:string,y:int>>,b:string>, n array<int>")
    got = {r["id"]: r.asDict(True) for r in outputs.nfc(d).collect()}
    assert got[1] == {"id": 1, "t": "Žiga Čeh", "l": ["Žiga Čeh", None], "m": {"k": "Žiga Čeh"}, "s": {"a": [{"x": "Žiga Čeh", "y": 2}], "b": None}, "n": [3]}
    assert set(got[2].values()) == {2, None} and outputs.nfc(d).schema.simpleString() == d.schema.simpleString()


def test_arrays_over_many_text_files(spark, tmp_path):
    rows = [("a.ged", k, f"n{k}", None if k % 2 else [k]) for k in range(200)] + [("b.ged", 7, 'q"\n', None)]
    d = spark.createDataFrame(rows, "file string, ord long, name string, more array<long>").repartition(5)
    files = spark.createDataFrame([("a.ged",), ("c.ged",)], "file string")
    outputs.write_arrays(d, str(tmp_path / "out"), ("ord",), files)
    read = {p.name: json.loads("".join(x.read_text() for x in sorted(p.glob("*.txt")))) for p in (tmp_path / "out").glob("file=*")}
    assert read == {"file=a.ged": [{"name": f"n{k}"} if k % 2 else {"name": f"n{k}", "more": [k]} for k in range(200)], "file=b.ged": [{"name": 'q"\n'}], "file=c.ged": []}


def test_contributors(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"Ana-B": {"url": "u", "intro": "hello", "x": 1},\n "C": {}}')
    assert {tuple(r) for r in outputs.read_contributors(spark, str(tmp_path / "c.json")).collect()} == {("Ana-B", "u", "hello"), ("C", None, None)}
    (tmp_path / "bad.json").write_text("not JSON")
    assert outputs.read_contributors(spark, str(tmp_path / "bad.json")).count() == 0
