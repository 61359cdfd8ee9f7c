"""Links that stand as evidence at persons, families and their events.

An element below a person or family gives links by its text (NOTE, with continuations), by the media
record it points to (OBJE), or as a citation (SOUR): links in its own value, else those of the source
it points to, else those in its PAGE, DATA/TEXT and DATA/WWW. A source record has a register's link in
its title, or pages: one link for each media record that shows a page. A citation's page number picks
the page's link, else replaces the page number in the source's first link.

What was cited is then routed (``placed``): a link stays at the event where it stands and goes as well
to the events that its kind names; one at the person itself goes by its kind alone. Everything is a join
on (file, pointer), (file, pointer, page) or (file, element), and an ordered list for each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import records, text
from kinforge.operators import links as kinds_of
from kinforge.operators.checkpoints import cut, stored
from kinforge.sources import ged

PAGE = r"\?pg=([0-9]+)"
#: where links of a person's elements belong, with the order in which the tags are read
PLACES = {"BIRT": ("birth", 0), "BAPM": ("birth", 1), "DEAT": ("death", 0), "BURI": ("death", 1), "CREM": ("death", 1), "NOTE": ("self", 0), "SOUR": ("self", 0), "OBJE": ("self", 0), "RESI": ("life", 0), "OCCU": ("life", 0)}
#: events of which only the first one's links are read
FIRST_ONLY = ("BIRT", "DEAT", "MARR")
CITED = ("NOTE", "SOUR", "OBJE")
GRAVES, CENSUS = ("geneanet", "findagrave", "billiongraves", "sistory"), "census"
#: order of a person's links: at the birth, sent there from the death, from the person, of other events; the same for the death
STAGES = {("birth", "birth"): 0, ("death", "birth"): 1, ("self", "birth"): 2, ("life", "birth"): 3, ("death", "death"): 4, ("birth", "death"): 5, ("self", "death"): 6}
#: and of those that belong to a marriage
MARRIAGES = {("self", "marriage"): 10, ("birth", "marriage"): 11, ("death", "marriage"): 12}


def media(nodes: DataFrame) -> DataFrame:
    """``file, value, url``: the first link of a known site of each media record, by its pointer; the last record of a pointer that has one counts."""
    d = nodes.where(F.col("rec_tag") == "OBJE")
    origin = d.where((F.col("level") == 1) & (F.col("tag") == "_ORIG")).select("file", F.col("ord").alias("parent"))
    files = d.where((F.col("level") == 1) & (F.col("tag") == "FILE")).select("file", "rec", "ord", "value")
    urls = d.where((F.col("level") == 2) & (F.col("tag") == "_URL")).join(origin, ["file", "parent"], "left_semi").select("file", "rec", "ord", "value")
    first = files.unionByName(urls).select("file", "rec", "ord", F.get(records.known_links(F.col("value")), F.lit(0)).alias("url")).where("url is not null")
    first = first.groupBy("file", "rec").agg(F.min_by("url", "ord").alias("url"))
    heads = d.where((F.col("level") == 0) & (F.coalesce("pointer", F.lit("")) != "")).select("file", "rec", F.col("pointer").alias("value"))
    return heads.join(first, ["file", "rec"]).groupBy("file", "value").agg(F.max_by("url", "rec").alias("url"))


def sources(nodes: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, value, template, paged`` of source records by pointer, and ``file, value, page, page_url``."""
    d = nodes.where((F.col("rec_tag") == "SOUR") & (F.col("level") == 1))
    title = records.first_link(F.col("value"), "matricula")
    titles = d.where(F.col("tag").isin("TITL", "ABBR")).select("file", "rec", "ord", title.alias("url")).where("url <> ''").groupBy("file", "rec").agg(F.min_by("url", "ord").alias("direct"))
    filed = d.where(F.col("tag") == "FILN").select("file", "rec").distinct()
    pages = d.where(F.col("tag") == "OBJE").select("file", "rec", "ord", "value").join(shown, ["file", "value"]).withColumn("page", F.regexp_extract("url", PAGE, 1)).where("page <> ''").join(filed, ["file", "rec"], "left_semi")
    heads = nodes.where((F.col("rec_tag") == "SOUR") & (F.col("level") == 0) & (F.coalesce("pointer", F.lit("")) != "")).select("file", "rec", F.col("pointer").alias("value"))
    first = pages.groupBy("file", "rec").agg(F.min_by("url", "ord").alias("first_page"))
    known = heads.join(titles, ["file", "rec"], "left").join(first, ["file", "rec"], "left").where("direct is not null or first_page is not null")
    known = known.groupBy("file", "value").agg(F.max(F.struct("rec", F.coalesce("direct", "first_page").alias("template"), F.col("direct").isNull().alias("paged"))).alias("s")).select("file", "value", "s.rec", "s.template", "s.paged")
    listed = pages.drop("value").join(known.where("paged").select("file", "rec", "value"), ["file", "rec"])
    return known.drop("rec"), listed.groupBy("file", "value", "page").agg(F.max_by("url", "ord").alias("page_url"))


def citations(nodes: DataFrame, texts: DataFrame, shown: DataFrame) -> DataFrame:
    """``file, ord, urls`` of the SOUR elements of persons and families."""
    owned = nodes.where(F.col("rec_tag").isin("INDI", "FAM"))
    c = owned.where(F.col("level").isin(1, 2) & (F.col("tag") == "SOUR")).select("file", "ord", F.coalesce("value", F.lit("")).alias("value"))
    low = owned.where(F.col("tag").isin("PAGE", "TEXT", "WWW", "DATA") & F.col("level").between(2, 4))
    data = low.where("tag = 'DATA'").select("file", F.col("ord").alias("parent"), F.col("parent").alias("of"))
    under = low.where(F.col("tag").isin("TEXT", "WWW")).join(data, ["file", "parent"]).select("file", "of", "ord")
    page = low.where("tag = 'PAGE'").select("file", F.col("parent").alias("of"), "ord", F.regexp_extract(F.coalesce("value", F.lit("")), r"[0-9]+", 0).alias("page"))
    said = under.unionByName(page.select("file", "of", "ord")).join(texts, ["file", "ord"]).select("file", F.col("of"), "ord", F.posexplode(records.known_links(F.col("text"))).alias("i", "url"))
    inline = said.groupBy("file", F.col("of").alias("ord")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "i", "url"))), lambda x: x["url"])).alias("inline"))
    number = page.where("page <> ''").groupBy("file", F.col("of").alias("ord")).agg(F.min_by("page", "ord").alias("page"))
    known, pages = sources(nodes, shown)
    d = c.join(number, ["file", "ord"], "left").join(inline, ["file", "ord"], "left").join(known, ["file", "value"], "left").join(pages, ["file", "value", "page"], "left")
    d = d.withColumn("own", records.known_links(F.col("value"))).withColumn("listed", records.known_links(F.col("template")))
    own, listed, none = F.col("own"), F.col("listed"), F.array().cast("array<string>")
    turned = F.array(records.with_page(F.col("template"), F.col("page")))
    by_page = F.when(F.col("page_url").isNotNull(), F.array("page_url")).when(F.col("page").isNotNull() & (F.col("paged") | F.col("template").rlike(PAGE)), turned)
    whole = F.when(F.size(listed) > 0, listed).otherwise(F.array("template"))
    urls = F.when(F.size(own) > 0, own).when(F.col("template").isNotNull(), F.coalesce(by_page, whole)).otherwise(F.coalesce("inline", none))
    return d.select("file", "ord", urls.alias("urls"))


def linked() -> dict[str, Column]:
    """An aggregate over a record's nodes: whether any of them can give a link."""
    gives = F.col("tag").isin("SOUR", "OBJE", "CONC", "CONT") | F.contains("value", F.lit("://"))
    return {"linked": F.max(F.coalesce(gives, F.lit(False)))}


def cited(nodes: DataFrame) -> DataFrame:
    """``file, rec, rec_tag, top, at, ord, i, url``: every link of an event or a record's own element, in order; ``at`` is the level-1 element ``top``.

    Of nodes marked as ``linked`` those are kept aside that can give links.
    """
    if "linked" in nodes.columns:
        useful = F.col("rec_tag").isin("OBJE", "SOUR") | (F.col("level") == 1) | F.col("tag").isin(*CITED, "PAGE", "DATA", "TEXT", "WWW", "CONC", "CONT")
        nodes = stored(nodes.where(F.col("linked") & useful).drop("linked"))
    owned = nodes.where(F.col("rec_tag").isin("INDI", "FAM"))
    spoken = owned.where((F.col("level") == 1) | F.col("tag").isin("NOTE", "PAGE", "TEXT", "WWW", "CONC", "CONT"))
    texts, shown = cut(ged.full_text(spoken)), cut(media(nodes))
    tops = owned.where(F.col("level") == 1).select("file", "rec", "rec_tag", F.col("ord").alias("at"), F.col("tag").alias("top"))
    own = tops.where(~F.col("top").isin(*CITED)).join(texts.withColumnRenamed("ord", "at"), ["file", "at"]).select(*tops.columns, F.col("at").alias("ord"), records.known_links(F.col("text")).alias("urls"))
    elements = owned.where(F.col("level").isin(1, 2) & F.col("tag").isin(*CITED)).select("file", F.when(F.col("level") == 1, F.col("ord")).otherwise(F.col("parent")).alias("at"), "ord", "level", "tag", "value").join(tops, ["file", "at"])
    elements = elements.where((F.col("level") == 1) | ~F.col("top").isin(*CITED))
    notes = elements.where("tag = 'NOTE'").join(texts, ["file", "ord"]).select(*own.columns[:-1], records.known_links(F.col("text")).alias("urls"))
    pictures = elements.where("tag = 'OBJE'").join(shown, ["file", "value"]).select(*own.columns[:-1], F.array("url").alias("urls"))
    sourced = elements.where("tag = 'SOUR'").join(citations(nodes, texts, shown), ["file", "ord"]).select(*own.columns[:-1], "urls")
    every = own.unionByName(notes).unionByName(pictures).unionByName(sourced)
    d = every.select("file", "rec", "rec_tag", "top", "at", "ord", F.posexplode("urls").alias("i", "url"))
    firsts = tops.where(F.col("top").isin(*FIRST_ONLY)).groupBy("file", "rec", "top").agg(F.min("at").alias("first"))
    return d.join(firsts, ["file", "rec", "top"], "left").where(F.coalesce(F.col("at") == F.col("first"), F.lit(True))).drop("first")


def no_cache(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.createDataFrame([], "base string, kinds array<string>, broken boolean")


def with_kinds(found: DataFrame, cache: DataFrame) -> DataFrame:
    """The links with ``kinds``: graves belong to a death, a census to a birth, registers by ``links.typed``."""
    kinds = F.when(records.is_site(F.col("url"), *GRAVES), F.array(F.lit("death"))).when(records.is_site(F.col("url"), CENSUS), F.array(F.lit("birth"))).otherwise(F.col("kinds"))
    return kinds_of.typed(found, cache).withColumn("kinds", kinds)


def _in_order(rows: Column) -> Column:
    return F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["url"]))


def placed(found: DataFrame, cache: DataFrame) -> DataFrame:
    """``file, rec, links, marriage_links`` of persons, from ``cited`` rows; the first are those of birth, life and death."""
    pairs = F.create_map(*[F.lit(x) for tag, (where, order) in PLACES.items() for x in (tag, f"{where},{order}")])
    d = found.where((F.col("rec_tag") == "INDI") & F.col("top").isin(*PLACES)).withColumn("p", F.split(pairs[F.col("top")], ","))
    d = with_kinds(d.withColumn("where", F.get("p", F.lit(0))).withColumn("turn", F.get("p", F.lit(1)).cast("int")), cache)
    own = F.when(F.col("where") == "life", F.lit("birth")).otherwise(F.col("where"))
    by_kind = F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("birth")))
    away = F.when(F.array_contains("kinds", own), F.array().cast("array<string>")).otherwise(F.col("kinds"))
    to = F.when(F.col("where") == "self", by_kind).when(F.col("where") == "life", F.array(own)).otherwise(F.concat(F.array(own), away))
    stages = F.create_map(*[F.lit(x) for (a, b), n in (STAGES | MARRIAGES).items() for x in (f"{a} {b}", n)])
    d = d.withColumn("to", F.explode(to)).withColumn("stage", stages[F.concat_ws(" ", "where", "to")])
    row = F.struct("stage", "turn", "at", "ord", "i", "url")
    for_life, wed = F.collect_list(F.when(F.col("stage") < 10, row)), F.collect_list(F.when(F.col("stage") >= 10, row))
    lists = d.groupBy("file", "rec").agg(_in_order(for_life).alias("l"), _in_order(wed).alias("w"))
    return lists.select("file", "rec", F.when(F.size("l") > 0, records.merged_links(F.col("l"))).alias("links"), records.merged_links(F.col("w")).alias("marriage_links"))


def of_families(found: DataFrame) -> DataFrame:
    """``file, rec, links`` of families: of the marriage, then of the family's own elements."""
    d = found.where((F.col("rec_tag") == "FAM") & F.col("top").isin("MARR", *CITED))
    row = F.struct((F.col("top") != "MARR").alias("own"), "at", "ord", "i", "url")
    return d.groupBy("file", "rec").agg(_in_order(F.collect_list(row)).alias("l")).select("file", "rec", records.merged_links(F.col("l")).alias("links"))
