"""Merging tree files and resolving duplicate persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import text


def renamed(value, i):
    """``@X@`` to ``@f{i}_X@`` for any value that begins and ends with an at sign."""
    return F.when(value.rlike(r"(?s)^@.*@\z") | (value == "@"), F.concat(F.lit("@f"), i.cast("string"), F.lit("_"), F.regexp_replace(value, "^@", ""))).otherwise(value)


def merge(nodes: DataFrame, files: list[str]) -> DataFrame:
    """All files' records in the order given, with pointers of their own, one head and one trailer."""
    order = F.element_at(F.create_map(*[x for i, f in enumerate(files, 1) for x in (F.lit(f), F.lit(i))]), F.col("file"))
    d = nodes.where(F.col("file").isin(files)).withColumn("_i", order)
    d = d.where((F.col("rec_tag") != "HEAD") | (F.col("_i") == 1)).where(F.col("rec_tag") != "TRLR")
    d = d.withColumn("pointer", renamed(F.col("pointer"), F.col("_i"))).withColumn("value", renamed(F.col("value"), F.col("_i")))
    base = F.col("_i").cast("decimal(20,6)") * F.lit(1000000000).cast("decimal(20,6)")
    move = lambda c: (c + base).cast("decimal(20,6)")
    d = d.select(F.lit("merged").alias("file"), (F.col("_i").cast("long") * 1000000000 + F.col("rec")).alias("rec"), move(F.col("ord")).alias("ord"), move(F.col("parent")).alias("parent"), "level", "pointer", "tag", "value", "rec_tag", F.transform("path", move).alias("path"))
    end = F.lit("9999999999999").cast("decimal(20,6)")
    trailer = nodes.sparkSession.range(1).select(F.lit("merged").alias("file"), F.lit(9999999999999).alias("rec"), end.alias("ord"), F.lit(None).cast("decimal(20,6)").alias("parent"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("pointer"), F.lit("TRLR").alias("tag"), F.lit("").alias("value"), F.lit("TRLR").alias("rec_tag"), F.array(end).alias("path"))
    return d.unionByName(trailer)


def duplicate_persons(people: DataFrame) -> DataFrame:
    """``file, ptr, master``: persons of equal lower-case names and raw birth date; the smallest pointer is the master."""
    p = people.where("given <> '' and surname <> '' and birth_date <> ''").select("file", "ptr", F.lower("surname").alias("s"), F.lower("given").alias("g"), "birth_date")
    groups = p.groupBy("file", "s", "g", "birth_date").agg(F.min("ptr").alias("master"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(groups, ["file", "s", "g", "birth_date"]).select("file", "ptr", "master")


def first_names(nodes: DataFrame) -> DataFrame:
    """``file, rec, ptr, given, surname, birth_date`` as duplicates are told by: the first name of whatever type, the raw date of the first birth."""
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec", F.col("pointer").alias("ptr"))
    named = nodes.where((F.col("level") == 1) & (F.col("rec_tag") == "INDI") & (F.col("tag") == "NAME")).groupBy("file", "rec").agg(F.min_by(F.coalesce("value", F.lit("")), "ord").alias("name"))
    births = nodes.where((F.col("level") == 1) & (F.col("rec_tag") == "INDI") & (F.col("tag") == "BIRT")).groupBy("file", "rec").agg(F.min("ord").alias("ord"))
    dates = nodes.where((F.col("level") == 2) & (F.col("tag") == "DATE")).groupBy("file", F.col("parent").alias("ord")).agg(F.min_by("value", "ord").alias("birth_date"))
    born = births.join(dates, ["file", "ord"]).select("file", "rec", "birth_date")
    d = heads.join(named, ["file", "rec"], "left").join(born, ["file", "rec"], "left")
    parts = text.name_parts(F.coalesce("name", F.lit("")))
    return d.select("file", "rec", "ptr", parts["given"].alias("given"), parts["surname"].alias("surname"), text.strip(F.coalesce("birth_date", F.lit(""))).alias("birth_date"))


def dedupe(nodes: DataFrame, dup: DataFrame) -> DataFrame:
    """Links to merged records go to their masters; merged records go.

    A master gains the FAMC/FAMS it lacks and, for each merged record, a NOTE with that record's other lines.
    """
    gone = dup.where("ptr <> master").select("file", F.col("ptr").alias("value"), "master")
    d = nodes.join(gone, ["file", "value"], "left").withColumn("value", F.coalesce("master", "value")).select(*nodes.columns)
    heads = nodes.where("level = 0").select("file", "rec", F.col("pointer").alias("ptr"))
    merged = heads.join(dup.where("ptr <> master"), ["file", "ptr"])
    target = heads.select("file", F.col("ptr").alias("master"), F.col("rec").alias("to"))
    last = nodes.groupBy("file", "rec").agg(F.max("ord").alias("end"), F.min("ord").alias("top")).withColumnRenamed("rec", "to")
    new = _missing_links(nodes, merged, target).unionByName(_notes(nodes, merged, target)).join(last, ["file", "to"])
    order = W.partitionBy("file", "to").orderBy("source", "at", "line")
    at = (F.col("end") + F.row_number().over(order) * F.lit("0.000001").cast("decimal(20,6)")).cast("decimal(20,6)")
    made = new.withColumn("ord", at).withColumn("note", F.last(F.when(F.col("tag") == "NOTE", F.col("ord")), True).over(order))
    below = F.col("level") == 2
    path = F.when(below, F.array("top", "note", "ord")).otherwise(F.array("top", "ord"))
    made = made.select("file", F.col("to").alias("rec"), "ord", F.when(below, F.col("note")).otherwise(F.col("top")).alias("parent"), "level", F.lit(None).cast("string").alias("pointer"), "tag", "value", F.lit("INDI").alias("rec_tag"), path.alias("path"))
    return d.join(merged.select("file", "rec"), ["file", "rec"], "left_anti").unionByName(made.select(*nodes.columns))


def _missing_links(nodes: DataFrame, merged: DataFrame, target: DataFrame) -> DataFrame:
    """New lines for the family links that masters lack, each once; they stand before the notes."""
    links = nodes.where((F.col("level") == 1) & F.col("tag").isin("FAMC", "FAMS"))
    have = links.select("file", F.col("rec").alias("to"), "tag", "value")
    lost = links.join(merged.select("file", "rec", "master"), ["file", "rec"]).select("file", "tag", "value", "master").distinct().join(target, ["file", "master"])
    order = F.concat_ws(" ", "tag", "value")
    return lost.join(have, ["file", "to", "tag", "value"], "left_anti").select("file", "to", F.lit("").alias("source"), F.lit(0).cast("decimal(20,6)").alias("at"), order.alias("line"), F.lit(1).alias("level"), "tag", "value")


def _notes(nodes: DataFrame, merged: DataFrame, target: DataFrame) -> DataFrame:
    """New lines for the notes: which record was merged, and its lines but for the family links."""
    source = merged.select("file", "rec", F.col("ptr").alias("source"), "master").join(target, ["file", "master"])
    top = W.partitionBy("file", "rec").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    own = nodes.join(source, ["file", "rec"]).where("level > 0").withColumn("_top", F.last(F.when(F.col("level") == 1, F.col("tag")), True).over(top)).where(~F.col("_top").isin("FAMC", "FAMS"))
    line = F.concat_ws(" ", F.col("level").cast("string"), "pointer", "tag", F.nullif("value", F.lit("")))
    row = lambda at, text_, level, tag: ("file", "to", "source", F.lit(at).cast("decimal(20,6)").alias("at") if isinstance(at, int) else at, F.lit("").alias("line"), F.lit(level).alias("level"), F.lit(tag).alias("tag"), text_.alias("value"))
    said = own.select(*row(F.col("ord").alias("at"), line, 2, "CONT"))
    first = source.select(*row(-2, F.concat(F.lit("Merged from duplicate record "), "source", F.lit(".")), 1, "NOTE"))
    return first.unionByName(own.select("file", "to", "source").distinct().select(*row(-1, F.lit("Original data:"), 2, "CONT"))).unionByName(said)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def exact_groups(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Rows that agree in the keys, with the least id by string order."""
    g = df.groupBy(*keys).agg(F.min(F.col(ident).cast("string")).alias("master"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.join(g, keys)


def ids(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumn("id", text.stable_id(*[F.col(f) for f in fields]))
