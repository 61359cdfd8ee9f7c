import unicodedata

import pytest
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators import tree
from kinforge.sources import ged

PLACEHOLDERS = [
    ("_?_", "NN"), ("(Unknown)", "NN"), ("-XXX-", "NN"), ("N. N.", "NN"), ("qqqq", "NN"), ("? / ?", "NN"), ("XY /NN/", "NN"), ("//", "NN"), ("", ""), ("II", "II"), ("XYla", "XYla"),
    ("_XY_ /Smith/", "NN /Smith/"), ("Jane //", "Jane /NN/"), ("Jane / neznan /", "Jane /NN/"), ("/ Smith /", "NN /Smith/"), ("/One/Two/Three/", "/One/Two/Three/"), ("___ Jane /Smith/", "___ Jane /Smith/"), (" Ana  Marija ", "Ana Marija"), ("J. /D/ II", "J. /D/ II"),
]
CAPITALS = [
    ("jOžE /kOvAč/", "Jože /Kovač/"), ("MARY-ANN /O'NEIL/", "Mary-Ann /O'Neil/"), ("FRANC DE PAULA /VON TRAPP/", "Franc de Paula /Von Trapp/"), ("de Vries /mcDonald/", "De Vries /Mcdonald/"), ("Franc /MacDonald/", "Franc /MacDonald/"), ("/VanDijk/", "/VanDijk/"),
    ("john (BIG j) smith", "John (BIG j) Smith"), ("(a) de /x/", "(a) De /X/"), ("nn /nn/", "NN /NN/"), ("ANA V. /K/", "Ana v. /K/"), ("luka //", "Luka //"), (" ", " "), ("", ""), ("ana / b  c /", "Ana /B C/"),
]
LOWER = [("JOŽE /KOVAČ/", "Jože /Kovač/"), ("John /SMITH/", "John /SMITH/"), ("jože  / kovač /", "jože /kovač/"), ("MARIA VON DER LEYEN", "Maria von der Leyen"), ("12", "12")]


@pytest.mark.parametrize(("rewrite", "cases"), [(text.clean_name_placeholder, PLACEHOLDERS), (text.capitalize_name, CAPITALS), (text.lower_if_shouted, LOWER)])
def test_rewrites(spark, rewrite, cases):
    d = spark.createDataFrame(cases, "raw string, want string").withColumn("got", rewrite(F.col("raw")))
    assert [(r["raw"], r["got"]) for r in d.collect()] == [(raw, want) for raw, want in cases]


def test_surname_elements_follow_the_name(spark):
    body = "0 @I1@ INDI\n1 NAME Jane //\n2 SURN Old\n1 NAME H /A/B/\n2 SURN A\n2 GIVN ___\n0 @I2@ INDI\n1 NAME ???\n2 SURN X\n1 SURN Z\n"
    n = ged.text_to_nodes(spark.createDataFrame([("a", body)], "file string, text string"))
    out = ged.serialize(tree.clean(n, ["name_placeholder"])).first()["text"]
    assert out == "0 @I1@ INDI\n1 NAME Jane /NN/\n2 SURN NN\n1 NAME H /A/B/\n2 SURN A/B\n2 GIVN NN\n0 @I2@ INDI\n1 NAME NN\n2 SURN\n1 SURN Z\n"


def test_collation_of_all_letters(spark):
    """Against the definition, letter by letter, and in words."""
    special = {"č": "c\x7d", "ć": "c\x7e", "đ": "d\x7f", "š": "s\x7f", "ž": "z\x7f"}
    want = lambda s: "".join(special.get(x) or unicodedata.normalize("NFD", x)[0] for x in s.casefold())
    letters = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    words = ["".join(letters[i : i + 20]) for i in range(0, len(letters), 20)] + ["Straße", "Žnidaršič", "ĐURIĆ", "Ångström", "Ñuñez", "İlhan", "ΌΣΟΣ", "", "ﬁn"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.collation_key(F.col("w")).alias("k")).collect()
    assert [r["k"] for r in got] == [want(r["w"]) for r in got]


def test_fold(spark):
    words = ["Žiga Čuček", "ÉÀÜ ñ", "e\u0301", "Đuro", "Łódź", "", None]
    got = [r["f"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold(F.col("w")).alias("f")).collect()]
    assert got == ["ziga cucek", "eau n", "e", "đuro", "łodz", "", None]
