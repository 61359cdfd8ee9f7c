"""Queries of the importers over inputs derived from the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import records
from kinforge.operators import importers
from kinforge.plans.derived import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _graves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as graves: every third has a partner, every seventh is not indexed yet."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(
        k.alias("row"), (k % 400).cast("string").alias("depot_id"), F.col("n_name").alias("place"), F.col("c_mktsegment").alias("nom_projet"), F.lit("cemetery").alias("type_projet"), F.lit("").alias("lat"), F.lit("").alias("lon"),
        F.when(k % 7 == 0, "").when(k % 2 == 0, "Ana").otherwise("Janez").alias("prenom"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("KOS"), F.lit(" "), F.col("n_name"))).alias("nom"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, "Luka").otherwise("Maja")).alias("prenom_conjoint"), F.when(k % 3 == 0, "ZORE").alias("nom_conjoint"),
        F.concat((F.lit(1850) + k % 100).cast("string"), F.lit("0500")).alias("date_naissance"), F.lit("00000000").alias("date_deces"), F.when(k % 5 == 0, "vulgo X, roj. Bizjak").otherwise("").alias("note"),
    )


@query
def grave_persons(spark, sf_dir):
    return importers.grave_persons(_graves(spark, sf_dir)).select("row", "role", "name", "surname", "sex", "alt_surname", "birth_date", "burial_place", "notes", F.length("id").alias("id_length"))


@query
def grave_families(spark, sf_dir):
    return importers.grave_families(_graves(spark, sf_dir)).select("row", F.col("husband.name").alias("husband"), F.col("wife.name").alias("wife"))


@query
def cemetery_stats(spark, sf_dir):
    return importers.cemetery_stats(_graves(spark, sf_dir)).select("cemetery", "place", "persons", "families", "graves")


def _births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as baptisms: every fourth father is unknown."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("seq"), F.concat(F.lit("Knjige/Indeks K Golac 1791-18"), F.lpad((k % 50).cast("string"), 2, "0"), F.lit(".xlsx")).alias("file"), k.alias("row"), F.lit("Golac").alias("parish"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("address"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("birth_date"), F.lit("(Fere, Flere)").alias("child_name"), F.when(k % 4 == 0, "ni znan").otherwise("Janez").alias("father_name"), F.when(k % 4 == 0, "ni znan").otherwise("Štibelj (Stibilj)").alias("father_surname"),
        F.lit("Ana").alias("mother_name"), F.lit("(Lah").alias("mother_surname"), F.when(k % 5 == 0, F.concat(F.lit("https://a.org/b/?pg="), k.cast("string"))).otherwise("").alias("url"), F.when(k % 6 == 0, "umrla 3. 2. 1850").otherwise("").alias("notes"),
    )


@query
def birth_records(spark, sf_dir):
    r = importers.birth_records(_births(spark, sf_dir).withColumn("key", F.col("seq")))
    return r.groupBy("name", "surname", F.col("birth.date").alias("born"), F.col("birth.place").alias("place"), "death", F.size("parents_list").alias("parents"), F.get("parents_list", F.lit(0))["name"].alias("father"), F.get("parents_list", F.lit(0))["alt_surname"].alias("father_alt"), F.size("links").alias("links")).agg(F.countDistinct("id").alias("n"))


@query
def book_index(spark, sf_dir):
    return importers.book_index(_births(spark, sf_dir))


@query
def whole_files(spark, sf_dir):
    """Books without any of the orders whose key ends in 13."""
    return importers.whole_files(_births(spark, sf_dir), F.col("seq") % 100 != 13).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def marriage_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.lit("Golac").alias("parish"), F.date_format("o_orderdate", "yyyy-MM").alias("marriage_date"), F.lit("Janez (Ivan, Johan)").alias("groom_name"), F.lit("(Belehar").alias("groom_surname"), F.lit("Belihar, Bobnar)").alias("groom_alt_surname"), F.lit("ni znan").alias("bride_name"), F.when(F.col("o_orderkey") % 2 == 0, "ni znan").otherwise("Kos").alias("bride_surname"))
    r = importers.marriage_records(rows)
    return r.groupBy(F.col("husband.name").alias("husband"), F.col("husband.surname").alias("surname"), F.col("husband.alt_surname").alias("alt"), F.col("wife.name").alias("wife"), F.col("wife.surname").alias("wife_surname"), F.col("marriage.date").alias("married")).agg(F.count(F.lit(1)).alias("n"))


@query
def fighter_records(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "Kos (Koss) dr. J. Janez").when(k % 3 == 1, "Novak Ivan (Johan)").otherwise("Zore mgr. inž. Ana")
    life = F.when(k % 2 == 0, "Golac, 1. 2. 1890 ― 3. 4. 1916, Galicija").otherwise("?. 5. 1890–? (žrtev vojne)")
    rows = s.select(k.alias("row"), name.alias("name"), life.alias("life"), F.lit("kovač").alias("occupation"), F.when(k % 4 == 0, " ").otherwise("IR 17").alias("unit"))
    r = importers.fighter_records(rows, "https://example.org/fighters")
    return r.groupBy("name", "surname", "alt_surname", F.col("birth.date").alias("born"), F.col("birth.place").alias("born_in"), F.col("death.date").alias("died"), F.col("death.place").alias("died_in"), "notes").agg(F.countDistinct("id").alias("n"))


@query
def known_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    k = F.col("page_id")
    url = [F.concat(F.lit(u), k.cast("string")) for u in ("http://data.matricula-online.eu/en/slovenia/lj/golac/1/?pg=", "https://data.matricula-online.eu/sl/slovenia/lj/golac/1/?pg=", "https://www.findagrave.com/memorial/", "https://sistory.si/ww1/")]
    note = F.concat(F.lit("see "), url[3], F.lit("; "), url[2], F.lit("). "), url[0], F.lit(", "), url[1], F.lit(" https://other.org/x"))
    return p.select("page_id", F.explode(records.merged_links(records.known_links(note))).alias("url"))


_GRAVES = """
    g AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 2 = 0 AS w, c_custkey % 5 = 0 AS m, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_ON = "day(o_orderdate) || ' ' || upper(strftime(o_orderdate, '%b')) || ' ' || year(o_orderdate)"
_BOOK = "'Knjige/Indeks K Golac 1791-18' || lpad((o_orderkey % 50)::VARCHAR, 2, '0') || '.xlsx'"

SQL = {
    "grave_persons": f"""
        WITH {_GRAVES}, t AS (SELECT k, upper(n_name[1]) || lower(n_name[2:]) AS n FROM g)
        SELECT k AS row, 'primary' AS role, CASE WHEN w THEN 'Ana' ELSE 'Janez' END AS name, 'Kos ' || n AS surname, CASE WHEN w THEN 'f' ELSE 'm' END AS sex, CASE WHEN m AND (w OR NOT b) THEN 'Bizjak' ELSE '' END AS alt_surname,
          'MAY ' || (1850 + k % 100) AS birth_date, n_name || ', ' || c_mktsegment AS burial_place, CASE WHEN m THEN 'vulgo X' ELSE '' END AS notes, 8 AS id_length FROM g JOIN t USING (k) WHERE a
        UNION ALL SELECT k, 'partner', CASE WHEN w THEN 'Luka' ELSE 'Maja' END, 'Zore', CASE WHEN w THEN 'm' ELSE 'f' END, CASE WHEN m AND a AND NOT w THEN 'Bizjak' WHEN m AND NOT a AND NOT w THEN 'Bizjak' ELSE '' END, '', n_name || ', ' || c_mktsegment, '', 8 FROM g WHERE b""",
    "grave_families": f"WITH {_GRAVES} SELECT k AS row, CASE WHEN w THEN 'Luka' ELSE 'Janez' END AS husband, CASE WHEN w THEN 'Ana' ELSE 'Maja' END AS wife FROM g WHERE a AND b",
    "cemetery_stats": f"""
        WITH {_GRAVES} SELECT c_mktsegment AS cemetery, arg_min(n_name, k) AS place, sum(a::INT + b::INT)::BIGINT AS persons, count(*) FILTER (a AND b) AS families, count(DISTINCT k % 400) AS graves FROM g WHERE a OR b GROUP BY 1""",
    "birth_records": f"""
        SELECT 'Fere (Flere)' AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'Lah' ELSE 'Štibelj' END AS surname, {_ON} AS born, 'Golac' || CASE WHEN o_orderkey % 2 = 0 THEN ', ' || o_orderstatus ELSE '' END AS place, CASE WHEN o_orderkey % 6 = 0 THEN '3 FEB 1850' ELSE '' END AS death, 2 AS parents,
          CASE WHEN o_orderkey % 4 = 0 THEN 'NN' ELSE 'Janez' END AS father, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Stibilj' END AS father_alt, (o_orderkey % 5 = 0)::INT AS links, count(*) AS n FROM orders GROUP BY ALL""",
    "book_index": f"""
        SELECT {_BOOK} AS file, 'Indeks K Golac 1791-18' || lpad((o_orderkey % 50)::VARCHAR, 2, '0') AS title, 'Golac' AS parish, 'birth' AS kind, '1791-18' || lpad((o_orderkey % 50)::VARCHAR, 2, '0') AS years, count(*) AS n, CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) > 0 THEN 'https://a.org/b/?pg=1' ELSE '' END AS url FROM orders GROUP BY 1, 2, 5""",
    "whole_files": f"WITH b AS (SELECT {_BOOK} AS file, o_orderkey % 100 = 13 AS bad FROM orders) SELECT file, count(*) AS n FROM b GROUP BY file HAVING NOT bool_or(bad)",
    "marriage_records": """
        SELECT 'Janez (Ivan Johan)' AS husband, 'Belehar' AS surname, 'Belihar, Bobnar' AS alt, 'NN' AS wife, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Kos' END AS wife_surname, upper(strftime(o_orderdate, '%b %Y')) AS married, count(*) AS n FROM orders GROUP BY ALL""",
    "fighter_records": """
        SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Janez' WHEN 1 THEN 'Ivan (Johan)' ELSE 'Ana' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Kos' WHEN 1 THEN 'Novak' ELSE 'Zore' END AS surname, CASE s_suppkey % 3 WHEN 0 THEN 'Koss' ELSE '' END AS alt_surname,
          CASE s_suppkey % 2 WHEN 0 THEN '1 FEB 1890' ELSE 'MAY 1890' END AS born, CASE s_suppkey % 2 WHEN 0 THEN 'Golac' ELSE '' END AS born_in, CASE s_suppkey % 2 WHEN 0 THEN '3 APR 1916' ELSE '' END AS died, CASE s_suppkey % 2 WHEN 0 THEN 'Galicija' ELSE '' END AS died_in,
          'Poklic: kovač' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '; Polk: IR 17' END || CASE s_suppkey % 3 WHEN 0 THEN '; Naziv: dr.; Inicialka: J.' WHEN 1 THEN '' ELSE '; Naziv: mgr. inž.' END AS notes, count(*) AS n FROM supplier GROUP BY ALL""",
    "known_links": """
        SELECT page_id, unnest(['https://data.matricula-online.eu/sl/slovenia/lj/golac/1/?pg=' || page_id, 'https://sistory.si/ww1/' || page_id, 'https://www.findagrave.com/memorial/' || page_id]) AS url FROM pages""",
}
