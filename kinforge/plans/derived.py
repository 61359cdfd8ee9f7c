"""Genealogical inputs derived from the driver's star-schema tables, column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LATIN = "Januarii Februarii Martii aprilis maii iunii iulii Augusti Septembris Octobris Novembris Decembris".split()


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, raw``: order dates written in 26 ways by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"), (F.col("o_orderkey") % 26).alias("k"))
    y, next_year, day = F.date_format("t", "yyyy"), (F.year("t") + 1).cast("string"), F.date_format("t", "d")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    latin = F.element_at(F.array(*[F.lit(m) for m in LATIN]), F.month("t"))
    forms = [
        F.date_format("t", "dd.MM.yyyy"), F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "MMM yyyy"), text("~", y), text(y, "?"), text("__.__.", y), text("FROM ", y, " TO ", next_year), text("before ", y), text("  ", y, ". "), text("?"),
        text("OD ", y), text(y, "/7"), text(y, "-1"), text(day, " ", latin, " ", y), text(y, " DO ", next_year), text("MED ", y, " - ", next_year), text("between ", y, " and ", next_year), text(".", F.date_format("t", "MM.yyyy")), text("17.3.", F.substring(y, 1, 3), "x"),
        text(day, ". Foo ", y), text("15 7bris ", y), text("Prred ", y), text("(", y, ")"), text(F.date_format("t", "dd.MM.yyyy"), "   7"), text("25.13.", y), text("nobody knows"),
    ]
    raw = F.when(F.col("k") == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        raw = raw.when(F.col("k") == i, f)
    return o.select("o_orderkey", raw.alias("raw"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, no, line``: each order a record with its items as level 1 and their attributes as level 2.

    A file holds a hundred orders; line numbers are spread so that they follow the keys.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    base = F.col("o_orderkey") * 1000
    row = lambda no, *text: F.struct(no.cast("long").alias("no"), F.concat(*text).alias("line"))
    key = F.col("o_orderkey").cast("string")
    heads = o.select(F.explode(F.array(row(base, F.lit("0 @O"), key, F.lit("@ INDI")), row(base + 1, F.lit("1 NAME "), F.col("o_orderstatus")))).alias("r"))
    at = base + F.col("l_linenumber") * 10
    items = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.explode(F.array(row(at, F.lit("1 EVEN "), F.col("l_linenumber").cast("string")), row(at + 1, F.lit("2 TYPE "), F.col("l_returnflag")), row(at + 2, F.lit("2 CHAN "), F.col("l_linestatus")))).alias("r"))
    return heads.unionByName(items).select(F.concat(F.lit("f"), F.floor(F.col("r.no") / 100000).cast("string")).alias("file"), "r.no", "r.line")


def kinship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, child, parent``: a customer's parents are the customers of key / 2 and key / 3."""
    c = table(spark, sf_dir, "customer").select("c_custkey").where("c_custkey > 1")
    both = c.select("c_custkey", F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("p")).where("p > 0")
    return both.select(F.lit("f").alias("file"), F.col("c_custkey").alias("child"), F.col("p").cast("long").alias("parent")).distinct()


def spouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, src, dst, kind``: family edges; an order joins its customer and the customer of key % 97 + 1."""
    o = table(spark, sf_dir, "orders")
    fam = F.concat(F.lit("F"), F.col("o_orderkey").cast("string"))
    one = o.select(F.lit("f").alias("file"), fam.alias("src"), F.col("o_custkey").alias("dst"), F.lit("husb").alias("kind"))
    two = o.select(F.lit("f").alias("file"), fam.alias("src"), (F.col("o_orderkey") % 97 + 1).alias("dst"), F.lit("wife").alias("kind"))
    return one.unionByName(two)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons: the market segment is the surname, the nation the place."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    born = F.when(F.col("c_custkey") % 4 == 0, "").otherwise((F.lit(1850) + F.col("c_custkey") % 100).cast("string"))
    return d.select(F.lit("f").alias("file"), F.col("c_custkey").alias("rec"), F.concat(F.lit("@I"), F.col("c_custkey").cast("string"), F.lit("@")).alias("ptr"), F.concat(F.element_at(F.split("c_name", "#"), 1), F.lit(" /"), F.col("c_mktsegment"), F.lit("/")).alias("name"), F.element_at(F.split("c_name", "#"), 1).alias("given"), F.col("c_mktsegment").alias("surname"), born.alias("birth_date"), F.col("n_name").alias("place"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, child, parent``: ten trees that are not connected, customers of one last digit each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 10).alias("r"), F.floor(F.col("c_custkey") / 10).alias("q")).where("q > 0")
    both = c.select("c", F.explode(F.array(F.floor(F.col("q") / 2) * 10 + F.col("r"), F.floor(F.col("q") / 3) * 10 + F.col("r"))).alias("p")).where("p > 0")
    return both.select(F.lit("f").alias("file"), F.col("c").alias("child"), F.col("p").cast("long").alias("parent")).distinct()


def _line(no, *text):
    return F.struct(no.cast("long").alias("no"), F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]).alias("line"))


#: lines of a row that are made together: more of them make code too large to be compiled
TOGETHER = 5


def _lines(df: DataFrame, *rows) -> DataFrame:
    """``file, no, line`` from lines of each row; null lines are left out. Some lines are made at a time, so that tasks share them even where one file holds all rows."""
    some = [df.select(F.explode(F.array(*rows[i : i + TOGETHER])).alias("r")).where("r.line is not null") for i in range(0, len(rows), TOGETHER)]
    return reduce(DataFrame.unionAll, some).select(F.lit("f").alias("file"), "r.no", "r.line")


FAMILIES_FROM = 10**12


def clan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons whose parents are the customers of key / 2 and key / 3; children of the same two are one family."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    c = c.withColumn("h", F.floor(F.col("c") / 2)).withColumn("w", F.floor(F.col("c") / 3))
    fam = F.concat(F.lit("@F"), F.col("h").cast("string"), F.lit("_"), F.col("w").cast("string"), F.lit("@"))
    at = F.col("c") * 1000
    persons = _lines(c, _line(at, "0 @I", F.col("c"), "@ INDI"), _line(at + 1, "1 NAME ", F.element_at(F.split("name", "#"), 1), " /", F.col("segment"), "/"), _line(at + 2, "1 FAMC ", F.when(F.col("h") > 0, fam)))
    pairs = c.where("h > 0").groupBy("h", "w").agg(F.min("c").alias("first"))
    wife = F.when((F.col("w") > 0) & (F.col("w") != F.col("h")), F.col("w"))
    top = F.lit(FAMILIES_FROM) + F.col("first") * 1000
    heads = _lines(pairs, _line(top, "0 ", fam, " FAM"), _line(top + 1, "1 HUSB @I", F.col("h"), "@"), _line(top + 2, "1 WIFE @I", wife, "@"))
    children = _lines(c.where("h > 0").join(pairs, ["h", "w"]), _line(top + 3 + F.col("c") - F.col("first"), "1 CHIL @I", F.col("c"), "@"))
    own = pairs.select("h", "w", "first", F.explode(F.filter(F.array(F.col("h"), wife), lambda x: x.isNotNull())).alias("p"))
    place = F.when(F.col("p") == F.col("h"), 3 + F.col("first") % 2).otherwise(5 + F.col("first") % 3)
    homes = _lines(own, _line(F.col("p") * 1000 + place, "1 FAMS ", fam))
    return persons.unionByName(heads).unionByName(children).unionByName(homes)


def wedding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, orders as families of the customer and the customer of key % 97 + 1, with a wedding date."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    at, top = F.col("c_custkey") * 10, F.lit(FAMILIES_FROM) + F.col("o_orderkey") * 10
    persons = _lines(c, _line(at, "0 @I", F.col("c_custkey"), "@ INDI"), _line(at + 1, "1 NAME C", F.col("c_custkey"), " /", F.col("c_mktsegment"), "/"))
    families = _lines(o, _line(top, "0 @F", F.col("o_orderkey"), "@ FAM"), _line(top + 1, "1 HUSB @I", F.col("o_custkey"), "@"), _line(top + 2, "1 WIFE @I", F.col("o_orderkey") % 97 + 1, "@"), _line(top + 3, "1 MARR"), _line(top + 4, "2 DATE ", F.upper(F.date_format("o_orderdate", "d MMM yyyy"))))
    return persons.unionByName(families)


def life_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as persons: born 60 to 149 years before the order, one in nine at an unknown time; one in four died in a known year, one in four at an unknown time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    k, at = F.col("o_orderkey"), F.col("o_orderkey") * 10
    return _lines(o, _line(at, "0 @O", k, "@ INDI"), _line(at + 1, "1 NAME P", k, " /X/"), _line(at + 2, "1 BIRT"), _line(at + 3, "2 DATE ", F.when(k % 9 != 0, F.col("y") - 60 - k % 90)), _line(at + 4, F.when(k % 4 == 0, F.lit("1 DEAT")).when(k % 4 == 1, F.lit("1 DEAT Y"))), _line(at + 5, "2 DATE ", F.when(k % 4 == 0, F.col("y") - k % 40)))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url``: every link in a page's HTML, those to a path below the page's own host."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return p.select("page_id", F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("url"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clan_lines`` with sexes, married names, events and links by key, and every 37th person said to be living."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k, at = F.col("k"), F.col("k") * 1000
    every = lambda n, c=None: F.when(k % n == 0, k if c is None else c)
    born = k % 4 != 3
    more = _lines(
        c, _line(at + 10, "1 SEX ", F.when(k % 3 == 0, "M").when(k % 3 == 1, "F")), _line(at + 12, "1 NAME X /M", every(8), "/"), _line(at + 13, "2 TYPE ", every(8, F.lit("married"))),
        _line(at + 20, F.when(born, F.lit("1 BIRT"))), _line(at + 21, "2 DATE ", F.when(born, F.lit(1700) + k % 200)), _line(at + 22, "2 PLAC N", F.when(born & (k % 2 == 0), k % 10)),
        _line(at + 23, "2 NOTE see https://data.matricula-online.eu/sl/a/b/c/MKU-", F.when(born, every(7)), "/?pg=1, there"),
        _line(at + 30, every(5, F.lit("1 BAPM"))), _line(at + 31, "2 DATE ", every(5, F.lit(1701) + k % 200)),
        _line(at + 40, every(6, F.lit("1 DEAT"))), _line(at + 41, "2 DATE ", every(6, F.lit(1800) + k % 150)), _line(at + 42, "2 SOUR https://www.findagrave.com/memorial/", every(6)),
        _line(at + 45, every(12, F.lit("1 BURI"))), _line(at + 46, "2 PLAC ", every(12, F.lit("P"))), _line(at + 50, "1 NOTE https://data.matricula-online.eu/en/a/b/c/MKP-", every(9), "/?pg=2"),
        _line(at + 51, "1 NOTE https://www.familysearch.org/ark:/61903/", every(10)), _line(at + 52, every(11, F.lit("1 RESI"))), _line(at + 53, "2 NOTE https://www.dlib.si/x/", every(11)), _line(at + 54, every(37, F.lit("1 NOTE living, no more is said"))),
    )
    return clan_lines(spark, sf_dir).unionByName(more)


def register_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources: by key one with two pages in media records, one with a link in its title, one with neither, one without pages; each cited by a person's birth, and by a family.

    The person cites the first page, one that no record shows, or none, by key.
    """
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.xxhash64("url").alias("h"))
    k, at = F.col("k"), F.col("k") * 100
    book = F.concat(F.lit("https://data.matricula-online.eu/sl/a/b/c/"), F.col("k").cast("string"), F.lit("/?pg="))
    paged = k % 4 == 0
    link = lambda cond, page: F.when(cond, F.concat(book, page.cast("string")))
    cites = F.when(k % 3 == 0, k % 7 + 1).when(k % 3 == 1, k % 7 + 2)
    return _lines(
        p, _line(at, "0 @M", k, "a@ OBJE"), _line(at + 1, "1 FILE ", link(F.lit(True), k % 7 + 1)), _line(at + 2, "0 @M", k, "b@ OBJE"), _line(at + 3, F.lit("1 _ORIG")), _line(at + 4, "2 _URL ", link(F.lit(True), k % 7 + 4)),
        _line(at + 10, "0 @S", k, "@ SOUR"), _line(at + 11, "1 TITL Book, ", link(k % 4 == 1, F.lit(1))), _line(at + 12, F.when((k % 4 == 0) | (k % 4 == 3), F.lit("1 FILN 7"))), _line(at + 13, "1 OBJE @M", F.when(paged, k), "a@"), _line(at + 14, "1 OBJE @M", F.when(paged, k), "b@"),
        _line(at + 20, "0 @I", k, "@ INDI"), _line(at + 21, "1 NAME P", k, " /X/"), _line(at + 22, F.lit("1 BIRT")), _line(at + 23, "2 SOUR @S", k, "@"), _line(at + 24, "3 PAGE p. ", cites),
        _line(at + 25, F.lit("3 DATA")), _line(at + 26, "4 TEXT at https://www.dlib.si/doc/", k), _line(at + 27, F.lit("5 CONC 5 and more")),
        _line(at + 30, "0 @F", k, "@ FAM"), _line(at + 31, "1 HUSB @I", k, "@"), _line(at + 32, "1 SOUR @S", k, "@"), _line(at + 33, "2 PAGE ", F.when(k % 2 == 0, k % 7 + 4)), _line(at + 34, "1 OBJE @M", F.when(k % 5 == 0, k), "b@"),
    )


def media_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as media records in circles of four, pairs of which show the same file; persons that show one, show one at their birth, or have a link below a source."""
    k = F.col("page_id")
    p, at = table(spark, sf_dir, "pages").select("page_id", "url"), k * 100
    third = lambda n: F.when(k % 3 == n, k)
    ahead = F.when(k % 4 == 3, k - 3).otherwise(k + 1)
    return _lines(
        p, _line(at, "0 @M", k, "@ OBJE"), _line(at + 1, "1 FILE ", F.when(k % 2 == 0, "https://Files.org/").otherwise("https://files.org/"), F.floor(k / 2)), _line(at + 3, "1 NOTE ", F.col("url")), _line(at + 4, "1 OBJE @M", ahead, "@"),
        _line(at + 10, "0 @I", k, "@ INDI"), _line(at + 11, "1 OBJE @M", third(0), "@"), _line(at + 12, "1 BIRT", F.when(k % 3 == 1, "")), _line(at + 13, "2 OBJE @M", third(1), "@"), _line(at + 14, "1 SOUR @S", third(2), "@"), _line(at + 15, "2 NOTE https://hidden.org/", third(2)),
        _line(at + 16, "1 NOTE https://own.org/", k),
    )


def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons and families with addresses below residences, in other addresses, and twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    k, at = F.col("k"), F.col("k") * 100
    third, fifth = F.when(k % 3 == 0, k), F.when(k % 5 == 0, k)
    return _lines(
        c, _line(at, "0 @I", k, "@ INDI"), _line(at + 1, "1 RESI"), _line(at + 2, "2 ADDR ", F.col("s")), _line(at + 3, "1 EVEN"), _line(at + 4, "2 PLAC"), _line(at + 5, "3 ADDR"), _line(at + 6, "4 ADDR Old building ", third), _line(at + 7, "1 ADDR  ", F.col("s"), " "),
        _line(at + 10, "0 @F", k, "@ FAM"), _line(at + 11, "1 MARR"), _line(at + 12, "2 ADDR Rebuilt ", fifth), _line(at + 20, "0 @S", k, "@ SUBM"), _line(at + 21, "1 ADDR building"),
    )


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, sheet, row, cells``: parts as rows of twenty workbooks with a sheet of names, one of records, whose columns begin later in every other file, and one more."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), (k % 20).cast("string")).alias("file"), (2 + F.floor(k / 20)).cast("int").alias("row"), (k % 2 * 3).cast("int").alias("shift"), "p_partkey", "p_brand", "p_name", "p_type")
    word = lambda c, n: F.element_at(F.split(c, " "), n)
    row = [k.cast("string"), F.concat(F.lit(" "), "p_brand"), F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"))), word("p_type", 1), word("p_name", 1), F.when(k % 5 == 0, word("p_name", 2))]
    titles = [F.lit(x) for x in (" ZP.  ŠT. ", "Ime otroka", None, "Ime Očeta", "Priimek očeta", "še kaj")]

    def cells(values):
        pairs = F.array(*[F.struct((F.lit(i) + F.col("shift")).alias("c"), v.cast("string").alias("v")) for i, v in enumerate(values, 1)])
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))

    blank = [F.when(k % 11 == 0, F.lit(" ")).otherwise(v) for v in row]
    sheet = lambda d, n, values, at=None: d.select("file", F.lit(n).alias("sheet"), (F.lit(at) if at else F.col("row")).alias("row"), cells(values).alias("cells"))
    files = p.select("file", "shift").distinct()
    out = sheet(files, 1, titles[:1], 1).unionByName(sheet(p, 1, row))
    for n in (2, 3):
        out = out.unionByName(sheet(files, n, titles, 1)).unionByName(sheet(p, n, blank))
    return out
