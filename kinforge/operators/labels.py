"""Readable labels of records and events, and rows of persons as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.operators import relational

#: fixed values: names of events
EVENTS = {"BIRT": "birth", "DEAT": "death", "MARR": "marriage", "BURI": "burial", "CHR": "christening", "DIV": "divorce", "EMIG": "emigration", "IMMI": "immigration", "NATU": "naturalization", "PROB": "probate"}


def event_label(tag: Column) -> Column:
    """The name of an event by its tag; empty for other tags."""
    out = F
    for t, name in EVENTS.items():
        out = out.when(tag == t, name)
    return out.otherwise("")


def _year(tags: tuple[str, ...]) -> Column:
    """The year of the first event of these tags whose first DATE shows one."""
    return F.min_by("year", F.when(F.col("tag").isin(*tags) & F.col("year").isNotNull(), F.col("ord")))


def person_labels(nodes: DataFrame) -> DataFrame:
    """``file, rec, ptr, label``: ``Given Surname (b.1850 d.1901)``; given name and surname elements stand in for an empty NAME, ``?`` for none."""
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec", F.col("pointer").alias("ptr"))
    value = F.coalesce(text.strip(F.col("value")), F.lit(""))
    spaced = text.strip(F.regexp_replace(F.replace(value, F.lit("/"), F.lit(" ")), r"(?U)\s+", " "))
    own = nodes.where((F.col("rec_tag") == "INDI") & (F.col("level") == 1) & (F.col("tag") == "NAME")).select("file", "rec", "ord", spaced.alias("name"))
    first = lambda tag: F.coalesce(F.min_by(value, F.when((F.col("tag") == tag) & (value != ""), F.col("ord"))), F.lit(""))
    parts = nodes.where((F.col("level") == 2) & F.col("tag").isin("GIVN", "SURN")).groupBy("file", F.col("parent").alias("ord")).agg(first("GIVN").alias("givn"), first("SURN").alias("surn"))
    spelled = F.when(F.col("name") != "", F.col("name")).otherwise(F.concat_ws(" ", F.nullif("givn", F.lit("")), F.nullif("surn", F.lit(""))))
    names = own.join(parts, ["file", "ord"], "left").withColumn("n", spelled).where("n <> ''").groupBy("file", "rec").agg(F.min_by("n", "ord").alias("name"))
    e = nodes.where((F.col("level") == 1) & F.col("tag").isin("BIRT", *relational.DEATH)).select("file", "rec", "ord", "tag")
    at = nodes.where((F.col("level") == 2) & (F.col("tag") == "DATE")).groupBy("file", F.col("parent").alias("ord")).agg(F.min_by(dates.year_strict(F.coalesce("value", F.lit(""))), "ord").alias("year"))
    life = e.join(at, ["file", "ord"]).groupBy("file", "rec").agg(_year(("BIRT",)).alias("b"), _year(relational.DEATH).alias("d"))
    years = F.concat_ws(" ", F.concat(F.lit("b."), F.col("b").cast("string")), F.concat(F.lit("d."), F.col("d").cast("string")))
    d = heads.join(names, ["file", "rec"], "left").join(life, ["file", "rec"], "left")
    return d.select("file", "rec", "ptr", F.concat(F.coalesce("name", F.lit("?")), F.when(years != "", F.concat(F.lit(" ("), years, F.lit(")"))).otherwise("")).alias("label"))


def family_labels(nodes: DataFrame) -> DataFrame:
    """``file, rec, ptr, label``: ``FAM  @F1@ — Husband + Wife`` in the order they stand; unknown spouses by their pointer, ``?`` for none."""
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).select("file", "rec", F.col("pointer").alias("ptr"))
    refs = nodes.where((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE")).select("file", "rec", "ord", text.strip(F.coalesce("value", F.lit(""))).alias("ref"))
    known = person_labels(nodes).select("file", F.col("ptr").alias("ref"), "label")
    both = refs.join(known, ["file", "ref"], "left").groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("label", "ref").alias("l")))).alias("s"))
    body = F.coalesce(F.array_join(F.transform("s", lambda x: x["l"]), " + "), F.lit("?"))
    return heads.join(both, ["file", "rec"], "left").select("file", "rec", "ptr", F.concat(F.lit("FAM  "), F.coalesce("ptr", F.lit("")), F.lit(" — "), body).alias("label"))


def record_labels(nodes: DataFrame) -> DataFrame:
    """``file, rec, label`` of every record: persons by name and years, other records by tag and pointer."""
    people = person_labels(nodes).select("file", "rec", F.col("label").alias("who"))
    heads = nodes.where("level = 0").select("file", "rec", "tag", F.coalesce("pointer", F.lit("")).alias("ptr")).join(people, ["file", "rec"], "left")
    label = F.when(F.col("tag") == "INDI", F.concat(F.lit("INDI "), "ptr", F.lit(" — "), "who")).when(F.col("tag") == "FAM", F.concat(F.lit("FAM  "), "ptr")).otherwise(text.strip(F.concat_ws(" ", "tag", "ptr")))
    return heads.select("file", "rec", label.alias("label"))


def person_line(given: Column, surname: Column, birth: Column, death: Column, place: Column, ident: Column | None = None) -> Column:
    """``Given Surname *birth +death place`` without the parts that are empty; ``?`` for a person without a name."""
    said = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    name = F.coalesce(said(text.strip(F.concat_ws(" ", said(given), said(surname)))), F.lit("?"))
    parts = [name, F.concat(F.lit("*"), said(birth)), F.concat(F.lit("+"), said(death)), said(place)]
    return F.concat_ws(" ", *([said(ident)] if ident is not None else []), *parts)
