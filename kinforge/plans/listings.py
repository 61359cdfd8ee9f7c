"""Queries of redacted trees, addresses, origins of surnames, link counts and sheets of records, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.operators import expand, media, merge, outputs, privacy, relational
from kinforge.operators.checkpoints import cut, stored
from kinforge.plans.chronicle import CLAN
from kinforge.plans.derived import address_lines, kinship, page_links, record_lines, sheet_cells, table
from kinforge.sources import ged, sheets

QUERIES: dict = {}
WAYS = ("private", "initials", "name")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _tree(lines):
    n = cut(ged.lines_to_nodes(lines))
    return n, n.where("level = 0").select("file", "rec", F.col("pointer").alias("id"))


@query
def filtered_private(spark, sf_dir):
    """What is left of persons without a death in a filtered tree, in each of three ways."""
    n = stored(ged.lines_to_nodes(record_lines(spark, sf_dir)).drop("path"))
    heads = n.where("level = 0").select("file", "rec", F.col("pointer").alias("id"))
    hidden = stored(privacy.marked(n, privacy.without_death(n))).where("_hit")  # one pass over the records for all ways
    left = [privacy.hidden_in_filtered(hidden, how).where("level > 0").select("file", "rec", "tag", "value", F.lit(how).alias("how")) for how in WAYS]
    return left[0].unionByName(left[1]).unionByName(left[2]).join(heads, ["file", "rec"]).select("id", "how", "tag", "value")


@query
def addresses(spark, sf_dir):
    """Addresses at any level that hold a word; of the persons only those of even keys."""
    n, heads = _tree(address_lines(spark, sf_dir))
    even = heads.where(F.regexp_extract("id", r"(\d+)@$", 1).cast("long") % 2 == 0)
    return relational.address_search(n, "bui", even).join(heads, ["file", "rec"]).select("id", "place", "address")


@query
def surname_first_places(spark, sf_dir):
    """Each surname's place by its earliest member of a known place, its own or that of ancestors of the name."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    people = c.select(F.lit("f").alias("file"), k.alias("ptr"), k.alias("rec"), F.col("c_mktsegment").alias("surname"), F.when(k % 4 == 0, "").otherwise((1850 + k % 100).cast("string")).alias("birth_date"), F.when(k % 97 == 0, F.col("n_name")).alias("place"))
    origins = expand.surname_origin(people.withColumnRenamed("ptr", "id"), kinship(spark, sf_dir))
    return relational.surname_origins(people, origins).select("surname", "members", "place")


@query
def link_counts(spark, sf_dir):
    return relational.link_counts(page_links(spark, sf_dir).withColumn("file", F.col("page_id") % 10))


@query
def first_name_duplicates(spark, sf_dir):
    """Duplicates by the first names and raw births of a tree."""
    n, _ = _tree(record_lines(spark, sf_dir))
    return merge.duplicate_persons(merge.first_names(n)).select("ptr", "master")


@query
def sheet_records(spark, sf_dir):
    """Records of workbooks whose sheets differ in headers and the order of their columns."""
    fields = ("seq", "child_name", "child_alt_name", "father_name", "father_surname", "father_alt_surname")
    d = sheets.known_rows(sheet_cells(spark, sf_dir))
    return d.select("file", "sheet", F.col("row").cast("long").alias("row"), *[F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")).alias(f) for f in fields])


@query
def listed_registers(spark, sf_dir):
    """Register links in texts and lists of records; those that are nested or too short do not count."""
    k = F.col("page_id").cast("string")
    book = lambda n: F.concat(F.lit("https://data.matricula-online.eu/sl/a/b/c/"), k, F.lit(f"/?pg={n}"))
    short = F.concat(F.lit("https://data.matricula-online.eu/sl/a/"), k)
    d = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see "), book(1), F.lit(" and <"), book(4), F.lit(">"))).alias("notes"), F.when(F.col("page_id") % 3 == 0, F.array(book(2), F.col("url"), short)).alias("links"), F.struct(book(3).alias("url")).alias("source"))
    return media.listed_registers(d)


@query
def composed_texts(spark, sf_dir):
    """Accents written as marks of their own, in a text and in a list of records."""
    c = table(spark, sf_dir, "customer")
    marked = F.concat("c_mktsegment", F.lit("e\u0301 "), "c_name")
    d = outputs.nfc(c.select("c_custkey", marked.alias("name"), F.array(F.struct(F.concat(F.lit("s\u030c"), "c_name").alias("of"), F.col("c_nationkey").alias("n"))).alias("more")))
    return d.select("c_custkey", "name", F.col("more")[0]["of"].alias("of"), F.col("more")[0]["n"].cast("long").alias("n"))


@query
def array_lines(spark, sf_dir):
    """Suppliers of each nation as a JSON array, nations without any as an empty one."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("alias"))
    return outputs.array_lines(rows, ("ord",), n.select(F.col("n_nationkey").alias("file"))).select("file", "last", F.coalesce("ord", F.lit(-1)).alias("ord"), "line")


SQL = {
    "filtered_private": f"""
        WITH {CLAN}, v AS (SELECT * FROM k WHERE c % 6 <> 0),
        r AS (SELECT c, 'SEX' AS tag, CASE c % 3 WHEN 0 THEN 'M' ELSE 'F' END AS value FROM v WHERE c % 3 < 2 UNION ALL SELECT c, 'FAMC', '@F' || f || '@' FROM v WHERE h IS NOT NULL
            UNION ALL SELECT me, 'FAMS', '@F' || m.f || '@' FROM m JOIN v ON v.c = me)
        SELECT '@I' || c || '@' AS id, how, tag, value FROM r, (VALUES ('private'), ('initials'), ('name')) w(how)
        UNION ALL SELECT '@I' || c || '@', how, 'NAME', CASE how WHEN 'private' THEN '<private>' WHEN 'name' THEN name || ' /' || surname || '/' ELSE left(name, 1) || '. /' || left(surname, 1) || './' END FROM v, (VALUES ('private'), ('initials'), ('name')) w(how)""",
    "addresses": """
        SELECT '@I' || c_custkey || '@' AS id, 1 AS place, c_mktsegment AS address FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING'
        UNION ALL SELECT '@I' || c_custkey || '@', CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END, 'Old building ' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0
        UNION ALL SELECT '@F' || c_custkey || '@', 1, 'Rebuilt ' || c_custkey FROM customer WHERE c_custkey % 5 = 0""",
    "surname_first_places": """
        WITH RECURSIVE x AS (SELECT c_custkey AS id, c_mktsegment AS s, CASE WHEN c_custkey % 97 = 0 THEN n_name ELSE '' END AS place, CASE WHEN c_custkey % 4 = 0 THEN 9999 ELSE 1850 + c_custkey % 100 END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
        e AS (SELECT * FROM (SELECT DISTINCT c_custkey AS c, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey > 1) WHERE p > 0),
        walk(who, id, s, place, depth) AS (SELECT id, id, s, place, 0 FROM x UNION SELECT who, x.id, x.s, x.place, depth + 1 FROM walk JOIN e ON c = walk.id JOIN x ON x.id = p AND x.s = walk.s WHERE walk.place = ''),
        best AS (SELECT who, arg_min(place, (depth, id)) AS place FROM walk WHERE place <> '' GROUP BY who)
        SELECT s AS surname, count(*) AS members, coalesce(arg_min(best.place, (b, id)) FILTER (best.place IS NOT NULL), '') AS place FROM x LEFT JOIN best ON who = id GROUP BY s""",
    "link_counts": """
        WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
        SELECT (page_id % 10)::VARCHAR AS place, count(*) AS links FROM l GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM l""",
    "first_name_duplicates": f"""
        WITH {CLAN}, p AS (SELECT '@I' || c || '@' AS ptr, surname, b FROM k WHERE b IS NOT NULL)
        SELECT ptr, master FROM (SELECT ptr, min(ptr) OVER w AS master, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY surname, b)) WHERE n > 1""",
    "sheet_records": """
        SELECT 'b' || p_partkey % 20 AS file, 2 AS sheet, 2 + p_partkey // 20 AS row, p_partkey::VARCHAR AS seq, p_brand AS child_name, CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_partkey ELSE '' END AS child_alt_name,
            split_part(p_type, ' ', 1) AS father_name, split_part(p_name, ' ', 1) AS father_surname, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) ELSE '' END AS father_alt_surname
        FROM part WHERE p_partkey % 11 <> 0""",
    "listed_registers": """
        WITH b AS (SELECT page_id AS k, 'https://data.matricula-online.eu/sl/a/b/c/' || page_id || '/?pg=' AS book FROM pages)
        SELECT book || unnest([1, 4]) AS url FROM b WHERE k % 2 = 0 UNION ALL SELECT book || 2 FROM b WHERE k % 3 = 0""",
    "composed_texts": """SELECT c_custkey, c_mktsegment || 'é ' || c_name AS name, 'š' || c_name AS of, c_nationkey::BIGINT AS n FROM customer""",
    "array_lines": """
        SELECT s_nationkey AS file, false AS last, s_suppkey AS ord, CASE WHEN s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) THEN '[' ELSE ',' END || '{"id":' || s_suppkey || ',"name":"' || s_name || '"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"alias":"' || s_name || '"' ELSE '' END || '}' AS line FROM supplier
        UNION ALL SELECT n_nationkey, true, -1, CASE WHEN count(s_suppkey) > 0 THEN ']' ELSE '[]' END FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
}
