"""What a link of a parish register is about, without a network: by its path, a cache of known links, or a page read before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import records

#: fixed values: signs of registers in a path
PATH_SIGNS = (("MKP", "marriage"), ("MKU", "death"), ("MKR", "birth"), ("MKK", "birth"))
#: fixed values: words on the page of a register, in the order in which kinds are told
PAGE_WORDS = {
    "birth": ("taufbuch", "krstna knjiga", "krsti", "taufen", "baptisms", "baptismal register"),
    "death": ("sterbebuch", "mrliška knjiga", "mrliči", "sterbefälle", "deaths", "burial register", "burials"),
    "marriage": ("trauungsbuch", "poročna knjiga", "poroke", "trauungen", "kopulationsbuch", "marriages", "marriage register"),
}
#: sites whose links are never typed: they stay with the event they stand at
UNTYPED = ("familysearch", "dlib")
BROKEN = "broken"
NONE = "array<string>"


def base_url(url: Column) -> Column:
    """The register's address, without the page asked for."""
    return F.regexp_extract(url, r"^([^?]*)", 1)


def page_kinds(html: Column) -> Column:
    """Kinds that a page's title and headings name, else those of the whole page without its links."""
    lower = F.lower(F.coalesce(html, F.lit("")))
    found = F.regexp_extract_all(lower, F.lit(r"(?s)<title>.*?</title>|<h\d[^>]*>.*?</h\d>"), F.lit(0))
    inner = F.array_join(F.transform(found, lambda t: F.regexp_replace(t, r"(?s)^<[^>]*>|</[^>]*>\z", "")), " ")

    def kinds(c: Column) -> Column:
        tests = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), kind) for kind, words in PAGE_WORDS.items()]
        return F.filter(F.array(*tests), lambda k: k.isNotNull())

    head = kinds(inner)
    return F.when(F.size(head) > 0, head).otherwise(kinds(F.regexp_replace(lower, r"(?s)<a\s+[^>]*>.*?</a>", "")))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``base, kinds, broken`` from JSON files of one object each: kinds by link, one or a list, ``broken``, or the old ``unknown``, which is dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("base", "v")).where("v <> 'unknown'")
    listed = F.coalesce(F.when(F.col("v").startswith("["), F.from_json("v", NONE)), F.array("v"))
    return whole.select("base", F.when(F.col("v") == BROKEN, F.array().cast(NONE)).otherwise(listed).alias("kinds"), (F.col("v") == BROKEN).alias("broken"))


def cache_from_pages(pages: DataFrame) -> DataFrame:
    """``base, kinds, broken`` from ``url, status, html`` of pages fetched elsewhere; status 404 is broken, other failures are left out."""
    d = pages.where((F.col("status") == 404) | F.col("status").between(200, 299))
    d = d.select(base_url(F.col("url")).alias("base"), F.when(F.col("status") == 404, F.array().cast(NONE)).otherwise(page_kinds(F.col("html"))).alias("kinds"), (F.col("status") == 404).alias("broken"))
    return d.groupBy("base").agg(F.min_by(F.struct("kinds", "broken"), F.struct("broken", "kinds")).alias("x")).select("base", "x.kinds", "x.broken")


def typed(links: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """The links with ``kinds``: by signs in the path, else by the cache, else none. Sites that cannot be typed have none."""
    signs = F
    for sign, kind in PATH_SIGNS:
        signs = signs.when(F.upper("_base").contains(sign), F.array(F.lit(kind)))
    untyped = F.col(url).isNull() | records.is_site(F.col(url), *UNTYPED)
    known = cache.select(F.col("base").alias("_base"), F.col("kinds").alias("_kinds")).dropDuplicates(["_base"])
    d = links.withColumn("_base", base_url(F.col(url))).join(known, "_base", "left")
    empty = F.array().cast(NONE)
    kinds = F.when(untyped, empty).otherwise(F.coalesce(signs.otherwise(F.lit(None).cast(NONE)), F.col("_kinds"), empty))
    return d.select(*links.columns, kinds.alias("kinds"))


def routed(links: DataFrame, cache: DataFrame, at: str = "at", url: str = "url") -> DataFrame:
    """``..., to``: one row for each event a link belongs to; a link without kinds stays where it stands."""
    own = F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(at))
    d = typed(links, cache, url)
    return d.select(*links.columns, F.explode(own).alias("to"))
