"""Queries of labels and kinds of links over inputs derived from the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.functions import records
from kinforge.operators import labels, links
from kinforge.plans.derived import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _customers(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query
def person_lines(spark, sf_dir):
    """Customers as persons: every third without a surname, every second without a place, every seventh dead, every 35th nameless."""
    k = F.col("c_custkey")
    given = F.when(k % 35 == 0, "").otherwise(F.col("c_name"))
    surname = F.when((k % 3 == 0) | (k % 35 == 0), "").otherwise(F.col("c_mktsegment"))
    line = labels.person_line(given, surname, (F.lit(1850) + k % 100).cast("string"), F.when(k % 7 == 0, "1950"), F.when(k % 2 == 0, F.col("n_name")).otherwise(""))
    return _customers(spark, sf_dir).select("c_custkey", line.alias("line"))


@query
def folder_names(spark, sf_dir):
    """Folders of a segment's beginning and a letter, against fields of segment and nation."""
    k = F.col("c_custkey")
    folder = F.concat(F.left("c_mktsegment", F.lit(4)), F.lit("-"), F.chr(65 + k % 26))
    return _customers(spark, sf_dir).select("c_custkey", records.names_folder(folder, F.concat("c_mktsegment", F.lit("_"), "n_name")).alias("named"))


@query
def page_kinds(spark, sf_dir):
    """Pages, some with headings or links of registers put in front."""
    k = F.col("page_id")
    put = F.when(k % 4 == 0, "<h1 class='x'>Taufbuch und Trauungen</h1>").when(k % 4 == 1, "<a href='x'>Sterbebuch</a>").when(k % 4 == 2, "<p>Burials and baptisms</p>").otherwise("")
    kinds = links.page_kinds(F.concat(put, F.coalesce("html", F.lit(""))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(kinds, " ").alias("kinds"))


@query
def link_kinds(spark, sf_dir):
    """Links with signs of registers in every fifth path, and a cache of every third address by its length."""
    p = table(spark, sf_dir, "pages")
    d = p.select("page_id", F.concat("url", F.when(F.col("page_id") % 5 == 0, "/mkp/?pg=1").when(F.col("page_id") % 5 == 1, "/MkU").otherwise("")).alias("url"))
    base = links.base_url(F.col("url"))
    cache = d.select(base.alias("base")).where(F.length("base") % 3 == 0).distinct().select("base", F.array(F.lit("birth"), F.lit("death")).alias("kinds"))
    return links.typed(d, cache).select("page_id", F.array_join("kinds", " ").alias("kinds"))


SQL = {
    "person_lines": """
        SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 35 = 0 THEN '?' WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' ' || c_mktsegment END,
            '*' || (1850 + c_custkey % 100), CASE WHEN c_custkey % 7 = 0 THEN '+1950' END, CASE WHEN c_custkey % 2 = 0 THEN n_name END) AS line
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "folder_names": r"""
        SELECT c_custkey, len(list_filter(regexp_split_to_array(lower(n_name), '[-_\s]+'), lambda x: starts_with(x, chr((97 + c_custkey % 26)::INT)))) > 0 AS named
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "page_kinds": r"""
        WITH p AS (SELECT page_id, lower(CASE page_id % 4 WHEN 0 THEN '<h1 class=''x''>Taufbuch und Trauungen</h1>' WHEN 1 THEN '<a href=''x''>Sterbebuch</a>' WHEN 2 THEN '<p>Burials and baptisms</p>' ELSE '' END || coalesce(html, '')) AS h FROM pages),
        t AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(h, '(?s)<title>.*?</title>|<h\d[^>]*>.*?</h\d>'), lambda x: regexp_replace(x, '(?s)^<[^>]*>|</[^>]*>$', '', 'g')), ' ') AS head, regexp_replace(h, '(?s)<a\s+[^>]*>.*?</a>', '', 'g') AS body FROM p),
        k(n, kind, words) AS (VALUES (1, 'birth', 'taufbuch|krstna knjiga|krsti|taufen|baptisms|baptismal register'), (2, 'death', 'sterbebuch|mrliška knjiga|mrliči|sterbefälle|deaths|burial register|burials'), (3, 'marriage', 'trauungsbuch|poročna knjiga|poroke|trauungen|kopulationsbuch|marriages|marriage register')),
        f AS (SELECT page_id, string_agg(CASE WHEN regexp_matches(head, words) THEN kind END, ' ' ORDER BY n) AS a, string_agg(CASE WHEN regexp_matches(body, words) THEN kind END, ' ' ORDER BY n) AS b FROM t CROSS JOIN k GROUP BY page_id)
        SELECT page_id, coalesce(a, b, '') AS kinds FROM f""",
    "link_kinds": r"""
        WITH d AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/mkp/?pg=1' WHEN 1 THEN '/MkU' ELSE '' END AS url FROM pages), b AS (SELECT page_id, url, split_part(url, '?', 1) AS base FROM d)
        SELECT page_id, CASE WHEN url IS NULL THEN '' WHEN upper(base) LIKE '%MKP%' THEN 'marriage' WHEN upper(base) LIKE '%MKU%' THEN 'death' WHEN upper(base) LIKE '%MKR%' OR upper(base) LIKE '%MKK%' THEN 'birth' WHEN length(base) % 3 = 0 THEN 'birth death' ELSE '' END AS kinds FROM b""",
}
