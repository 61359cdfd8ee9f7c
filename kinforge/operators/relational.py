"""Person, family, surname, link, address and statistics queries over nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import dates, text

LABELS = ("INDI", "FAM", "SOUR", "REPO", "OBJE", "NOTE", "SUBM")
DEATH = ("DEAT", "BURI", "CREM")


def events(nodes: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """``file, rec, tag, ord, date, place``: level-1 events; within one the last DATE and PLAC count."""
    e = nodes.where((F.col("level") == 1) & F.col("tag").isin(*tags)).select("file", "rec", "tag", "ord", "value")
    below = nodes.where((F.col("level") == 2) & F.col("tag").isin("DATE", "PLAC")).groupBy("file", F.col("parent").alias("ord")).agg(F.max_by(F.when(F.col("tag") == "DATE", F.col("value")), F.when(F.col("tag") == "DATE", F.col("ord"))).alias("date"), F.max_by(F.when(F.col("tag") == "PLAC", F.col("value")), F.when(F.col("tag") == "PLAC", F.col("ord"))).alias("place"))
    return e.join(below, ["file", "ord"], "left")


def first_event(e: DataFrame, tag: str, name: str) -> DataFrame:
    return e.where(F.col("tag") == tag).groupBy("file", "rec").agg(F.min_by("date", "ord").alias(f"{name}_date"), F.min_by("place", "ord").alias(f"{name}_place"))


def names(nodes: DataFrame) -> DataFrame:
    """``file, rec, name``: the first NAME without a TYPE or of type birth, else the first."""
    n = nodes.where((F.col("level") == 1) & (F.col("tag") == "NAME") & (F.col("rec_tag") == "INDI")).select("file", "rec", "ord", "value")
    kinds = nodes.where((F.col("level") == 2) & (F.col("tag") == "TYPE")).select("file", F.col("parent").alias("ord"), F.lower("value").alias("type"))
    rank = F.when(F.col("type").isNull() | (F.col("type") == "birth"), 0).otherwise(1)
    return n.join(kinds, ["file", "ord"], "left").groupBy("file", "rec").agg(F.min_by("value", F.struct(rank.alias("r"), F.col("ord"))).alias("name"))


def persons(nodes: DataFrame) -> DataFrame:
    """``file, rec, ptr, name, given, surname, sex, birth_date, death_date, place``."""
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec", F.col("pointer").alias("ptr"))
    sex = nodes.where((F.col("level") == 1) & (F.col("tag") == "SEX")).groupBy("file", "rec").agg(F.min_by("value", "ord").alias("sex"))
    e = events(nodes, ("BIRT", "CHR", "RESI", "DEAT"))
    d = heads.join(names(nodes), ["file", "rec"], "left").join(sex, ["file", "rec"], "left")
    for tag, name in (("BIRT", "birth"), ("CHR", "chr"), ("RESI", "resi"), ("DEAT", "death")):
        d = d.join(first_event(e, tag, name), ["file", "rec"], "left")
    parts = text.name_parts(F.coalesce("name", F.lit("")))
    place = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("birth_place", "chr_place", "resi_place", "death_place")], F.lit(""))
    return d.select("file", "rec", "ptr", "name", parts["given"].alias("given"), parts["surname"].alias("surname"), text.sex_code(F.coalesce("sex", F.lit(""))).alias("sex"), F.coalesce("birth_date", F.lit("")).alias("birth_date"), F.coalesce("death_date", F.lit("")).alias("death_date"), place.alias("place"))


def families(nodes: DataFrame, people: DataFrame) -> DataFrame:
    """``file, rec, ptr, husband, wife, marriage_date, marriage_place``: the last spouse tag that resolves counts."""
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).select("file", "rec", F.col("pointer").alias("ptr"))
    refs = nodes.where((F.col("level") == 1) & (F.col("rec_tag") == "FAM") & F.col("tag").isin("HUSB", "WIFE")).select("file", "rec", "tag", "ord", F.col("value").alias("ptr"))
    known = refs.join(people.select("file", "ptr", "name"), ["file", "ptr"])
    spouses = known.groupBy("file", "rec").agg(*[F.max_by(F.when(F.col("tag") == t, F.col("name")), F.when(F.col("tag") == t, F.col("ord"))).alias(n) for t, n in (("HUSB", "husband"), ("WIFE", "wife"))])
    return heads.join(spouses, ["file", "rec"], "left").join(first_event(events(nodes, ("MARR",)), "MARR", "marriage"), ["file", "rec"], "left")


def find_persons(people: DataFrame, words: str | None = None, pointer: str | None = None, year: int | None = None) -> DataFrame:
    """By pointer, or by words that all occur in the name, and a birth year."""
    if pointer is not None:
        return people.where(F.lower(F.regexp_replace("ptr", "@", "")) == pointer.strip("@").lower())
    out = people
    for w in (words or "").lower().split():
        out = out.where(F.contains(F.lower("name"), F.lit(w)))
    return out if year is None else out.where(dates.year_query(F.col("birth_date")) == year)


def _asked(spec: str) -> tuple:
    """(spec, pointer, given, surname, year) of ``@I1@`` or of ``[Given names] Surname [1850]``."""
    spec = spec.strip()
    if spec.startswith("@") and spec.endswith("@"):
        return spec, spec, None, None, None
    words = spec.split()
    year = int(words.pop()) if words and re.fullmatch(r"\d{4}", words[-1]) else None
    if not words:
        raise ValueError(f"{spec!r} names nobody")
    return spec, None, " ".join(words[:-1]).lower() or None, words[-1].lower(), year


def named_persons(people: DataFrame, specs: list[str]) -> DataFrame:
    """The persons whom any of the specs names, with ``spec``: by pointer, or by whole surname, given names and year of birth where they are named, without regard to case."""
    asked = people.sparkSession.createDataFrame([_asked(x) for x in dict.fromkeys(specs)], "spec string, _ptr string, _given string, _surname string, _year int")
    by_pointer = people.join(asked.where("_ptr is not null").select("spec", F.col("_ptr").alias("ptr")), "ptr")
    by_name = people.withColumn("_surname", F.lower("surname")).join(asked.where("_ptr is null"), "_surname")
    fits = (F.col("_given").isNull() | (F.lower("given") == F.col("_given"))) & (F.col("_year").isNull() | F.coalesce(dates.year_query(F.col("birth_date")) == F.col("_year"), F.lit(False)))
    return by_pointer.select(*people.columns, "spec").unionByName(by_name.where(fits).select(*people.columns, "spec"))


def one_person(people: DataFrame, spec: str, shown: int = 10) -> DataFrame:
    """The one person (file, id) whom the spec names; an error tells if it is nobody, or several."""
    found = named_persons(people, [spec]).select("file", F.col("ptr").alias("id"))
    some = found.orderBy("file", "id").limit(shown + 1).collect()
    if len(some) != 1:
        more = "" if len(some) <= shown else " and more"
        raise ValueError(f"{spec!r} names nobody" if not some else f"{spec!r} names several persons: {', '.join(r['id'] for r in some[:shown])}{more}")
    return found


def home_persons(nodes: DataFrame) -> DataFrame:
    """``file, id`` of the persons marked as where a tree starts."""
    marked = nodes.where((F.col("rec_tag") == "INDI") & (F.col("level") == 1) & (F.col("tag") == "_STP")).select("file", "rec").distinct()
    return nodes.where("level = 0").join(marked, ["file", "rec"]).select("file", F.col("pointer").alias("id"))


def surnames(people: DataFrame) -> DataFrame:
    """Distinct surnames with their collation key."""
    return people.where("surname <> ''").select("surname").distinct().withColumn("sort_key", text.collation_key(F.col("surname")))


def surname_places(people: DataFrame) -> DataFrame:
    """Each surname's place of its earliest dated member, undated ones last."""
    rank = F.struct((F.col("birth_date") == "").alias("undated"), F.col("birth_date"), F.col("rec"))
    with_place = F.when(F.col("place") != "", rank)
    return people.where("surname <> ''").groupBy("surname").agg(F.count(F.lit(1)).alias("members"), F.min_by("place", with_place).alias("place"))


def surname_origins(people: DataFrame, origins: DataFrame) -> DataFrame:
    """``file, surname, members, place``: the first place known of any member, those with a date of birth first and in the order of its text.

    ``origins`` (file, id, place) says where each person's name comes from (``expand.surname_origin``).
    """
    rank = F.struct((F.col("birth_date") == "").alias("undated"), "birth_date", "rec")
    d = people.where("surname <> ''").select("file", "ptr", "rec", "surname", F.coalesce("birth_date", F.lit("")).alias("birth_date"))
    d = d.join(origins.select("file", F.col("id").alias("ptr"), F.col("place")), ["file", "ptr"], "left")
    found = F.min_by("place", F.when(F.coalesce("place", F.lit("")) != "", rank))
    return d.groupBy("file", "surname").agg(F.count(F.lit(1)).alias("members"), F.coalesce(found, F.lit("")).alias("place"))


def stats(nodes: DataFrame) -> DataFrame:
    """``file, label, n``: level-0 records by tag, always with the known labels, and distinct places."""
    spark = nodes.sparkSession
    files = nodes.select("file").distinct()
    known = files.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in LABELS], "label string")))
    counts = nodes.where((F.col("level") == 0) & ~F.col("tag").isin("HEAD", "TRLR")).groupBy("file", F.col("tag").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    places = nodes.where((F.col("tag") == "PLAC") & (F.coalesce("value", F.lit("")) != "")).groupBy("file").agg(F.countDistinct("value").alias("n")).select("file", F.lit("PLACES").alias("label"), "n")
    return known.join(counts, ["file", "label"], "full").select("file", "label", F.coalesce("n", F.lit(0)).alias("n")).unionByName(places)


def url_search(nodes: DataFrame, pattern: str = "") -> DataFrame:
    """``file, rec, url``: links in a record's values, or in the media records it points to, that hold the pattern."""
    urls = nodes.select("file", "rec", "rec_tag", F.explode(text.find_urls(F.coalesce("value", F.lit("")))).alias("url"))
    own = urls.where(F.col("rec_tag").isin("INDI", "FAM")).select("file", "rec", "url")
    media = urls.where("rec_tag = 'OBJE'").join(nodes.where("level = 0").select("file", "rec", "pointer"), ["file", "rec"]).select("file", F.col("pointer").alias("value"), "url")
    via = nodes.where((F.col("tag") == "OBJE") & F.col("rec_tag").isin("INDI", "FAM")).select("file", "rec", "value").join(media, ["file", "value"]).select("file", "rec", "url")
    return own.unionByName(via).distinct().where(F.contains(F.lower("url"), F.lit(pattern.lower())))


def address_search(nodes: DataFrame, pattern: str = "", only: DataFrame | None = None) -> DataFrame:
    """``file, rec, place, address``: each address that a person or family has at any level, once, in their order, if it holds the pattern.

    ``only`` (file, rec) restricts the persons, not the families.
    """
    address = text.strip(F.coalesce("value", F.lit("")))
    d = nodes.where((F.col("tag") == "ADDR") & (F.col("level") > 0) & F.col("rec_tag").isin("INDI", "FAM")).select("file", "rec", "rec_tag", "ord", address.alias("address"))
    d = d.where((F.col("address") != "") & F.contains(F.lower("address"), F.lit(pattern.lower())))
    if only is not None:
        d = d.join(only.select("file", "rec", F.lit(True).alias("_in")).distinct(), ["file", "rec"], "left").where(F.col("_in") | (F.col("rec_tag") == "FAM"))
    d = d.groupBy("file", "rec", "address").agg(F.min("ord").alias("ord"))
    return d.select("file", "rec", F.row_number().over(W.partitionBy("file", "rec").orderBy("ord")).alias("place"), "address")


def duplicate_urls(urls: DataFrame, key: str = "url", owner: str = "owner") -> DataFrame:
    """``url_key, owner, n`` for links (url, owner) that several owners share, by lower case without a last slash."""
    d = urls.select(text.url_key(F.col(key)).alias("url_key"), F.col(owner).alias("owner")).distinct()
    shared = d.groupBy("url_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(shared, "url_key")


def top_links(urls: DataFrame, key: Column, place: str, n: int) -> DataFrame:
    """The n most frequent keys; the first to appear goes first among equals."""
    return urls.groupBy(key.alias("link_key")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy(F.col("n").desc(), "first").limit(n)


def link_counts(links: DataFrame, place: str = "file") -> DataFrame:
    """``place, links``: how many links each place has, and all of them as TOTAL."""
    return links.groupBy(F.col(place).cast("string").alias("place")).agg(F.count(F.lit(1)).alias("links")).unionByName(links.agg(F.count(F.lit(1)).alias("links")).select(F.lit("TOTAL").alias("place"), "links"))


def link_audit(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Links (url, label) that are not among the listed ones, with their labels in order."""
    k = text.url_key(F.col("url"))
    missing = found.withColumn("k", k).join(listed.select(k.alias("k")).distinct(), "k", "left_anti")
    return missing.groupBy("k").agg(F.min("url").alias("url"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels")).select("url", "labels")


def ordered(df: DataFrame, *cols: str, tie: str | None = None) -> DataFrame:
    return df.orderBy(*[text.collation_key(F.col(c)) for c in cols], *([tie] if tie else []))


def totals(changes: DataFrame) -> DataFrame:
    """Counts by file and processor with a TOTAL for each and both."""
    return changes.rollup("file", "processor").agg(F.sum("n").alias("n")).select(F.coalesce("file", F.lit("TOTAL")).alias("file"), F.coalesce("processor", F.lit("TOTAL")).alias("processor"), "n")
