"""Chat formatting by quotation linking.

A message's lines begin with any number of quote marks (``>``); their number is the line's level.
Lines of level 0 are the message's own text. Runs of lines of one level above 0 are quoted
passages. Passages, own lines, own paragraphs (runs of own lines between blank or quoted lines) and
whole own texts are normalised (lower case, white space and marks collapsed) and hashed; a level-1
passage is joined to the message of the same conversation that has the same own text, paragraph or
line and the latest turn before it. A passage that is found nowhere as a whole is joined by its
paragraphs (between blank quoted lines), or else by its single lines. The latest message found is
the reply's parent. Passages of deeper levels link to older messages and count in ``n_links``
only, once a passage. Conversations are rebuilt as threads: ``path`` lists the
turns from the root to the message, and sorting by (conv_id, path) gives reply order.

Each message is a row of its own throughout, so a long conversation is never gathered in one task;
the joins are on (conv_id, hash) and the paths double with each round.

Defined cases: null and empty texts have no own text, passages or links; a quotation without an
original leaves its message a root; of repeated (conv_id, turn) rows each is kept, and a reply
joins the turn once; rows with a null conv_id or turn are roots with an empty path's own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, no_null, table

MARKS = r"^(?:[ \t]*>)+[ \t]?"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Adds ``own`` (text without quotes), ``passages`` (level, text) and ``paragraphs``."""
    lines = F.transform(F.split(no_null(text), r"\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))

    def add(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        blank = (x["level"] == 0) & (F.trim(x["body"]) == "")
        joins = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["level"] == x["level"]) & ~blank & ~F.coalesce(F.try_element_at(runs, F.lit(-1))["closed"], F.lit(False))
        more = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat(F.try_element_at(runs, F.lit(-1))["body"], F.lit("\n"), x["body"]).alias("body"), F.lit(False).alias("closed"))))
        new = F.concat(runs, F.array(F.struct(x["level"].alias("level"), x["body"].alias("body"), blank.alias("closed"))))
        del last
        return F.when(joins, more).otherwise(new)

    runs = F.aggregate("_lines", F.array().cast("array<struct<level:int,body:string,closed:boolean>>"), add)
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    m = messages.withColumn("_lines", lines).withColumn("_runs", F.when(F.exists("_lines", lambda x: x["level"] > 0), runs))
    m = m.withColumn("own", F.regexp_replace(own, r"\A\s+|\s+\z", ""))
    m = m.withColumn("paragraphs", F.coalesce(F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["body"]), F.array().cast("array<string>")))
    m = m.withColumn("passages", F.coalesce(F.filter("_runs", lambda r: (r["level"] > 0) & (normal(r["body"]) != "")), F.array().cast("array<struct<level:int,body:string,closed:boolean>>")))
    return m.drop("_lines", "_runs")


def hashes(parts: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda t: t != ""), lambda t: F.xxhash64(t)))


def paragraphs_of(text: Column) -> Column:
    return F.split(text, r"\n[ \t]*\n")


def own_hashes(own: Column, paragraphs: Column) -> Column:
    """Hashes of the whole own text, of each of its paragraphs (those between quotations too) and of its lines."""
    return hashes(F.concat(F.array(own), paragraphs_of(own), paragraphs, F.split(own, "\n")))


def latest(pieces: DataFrame, originals: DataFrame) -> DataFrame:
    """The latest earlier original ``o`` of each passage (c, t, level, p), by the largest of its pieces (size, h) that has one."""
    # both kinds stand in one list by turn, so a line owned m times and quoted n times makes m + n rows
    asked = originals.join(pieces.select("c", "h").distinct(), ["c", "h"], "left_semi")
    line = pieces.select("c", "h", "t", "level", "p", "size", F.lit(None).cast(originals.schema["o"].dataType).alias("own"))
    both = line.unionByName(asked.select("c", "h", F.col("o").alias("t"), F.col("o").alias("own")), allowMissingColumns=True)
    earlier = W.partitionBy("c", "h").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    met = both.withColumn("o", F.max("own").over(earlier)).where("own is null and o is not null")
    return met.groupBy("c", "t", "level", "p").agg(F.max(F.struct("size", "o"))["o"].alias("o"))


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row a message: its columns but with the text unquoted, and parent_turn, depth, path, n_passages, n_links."""
    m = parsed(messages, conv, turn, text)
    body = F.col("p.body")
    quoted = m.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.explode("passages").alias("p")).select("c", "t", F.col("p.level").alias("level"), F.xxhash64(normal(body)).alias("p"), hashes(paragraphs_of(body)).alias("paragraphs"), hashes(F.split(body, "\n")).alias("lines"))
    quoted = quoted.dropDuplicates(["c", "t", "level", "p"])
    originals = m.select(F.col(conv).alias("c"), F.col(turn).alias("o"), F.explode(own_hashes(F.col("own"), F.col("paragraphs"))).alias("h")).distinct()
    whole = cut(latest(quoted.select("c", "t", "level", "p", F.lit(2).alias("size"), F.col("p").alias("h")), originals))
    left = quoted.join(whole.select("c", "t", "level", "p"), ["c", "t", "level", "p"], "left_anti")
    sized = F.concat(F.transform("paragraphs", lambda h: F.struct(F.lit(1).alias("size"), h.alias("h"))), F.transform(F.array_except("lines", "paragraphs"), lambda h: F.struct(F.lit(0).alias("size"), h.alias("h"))))
    part = latest(left.select("c", "t", "level", "p", F.explode(sized).alias("s")).select("c", "t", "level", "p", "s.size", "s.h").where("h <> p"), originals)
    linked = whole.unionByName(part)
    parents = cut(linked.groupBy("c", "t").agg(F.max(F.when(F.col("level") == 1, F.col("o"))).alias("parent_turn"), F.countDistinct("level", "p").cast("long").alias("n_links")))
    paths = cut(parents.where("parent_turn is not null").select("c", "t", F.array("t").alias("path"), F.col("parent_turn").alias("up")))
    while not paths.where("up is not null").isEmpty():
        above = paths.select("c", F.col("t").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"))
        paths = cut(paths.join(above, ["c", "up"], "left").select("c", "t", F.when(F.col("more").isNotNull(), F.concat("more", "path")).when(F.col("up").isNotNull(), F.concat(F.array("up"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.col("next").alias("up")))
    out = m.join(parents.join(paths.select("c", "t", "path"), ["c", "t"], "left").withColumnsRenamed({"c": "_c", "t": "_t"}), (F.col(conv) == F.col("_c")) & (F.col(turn) == F.col("_t")), "left")
    path = F.coalesce("path", F.array(F.col(turn)))
    return out.select(*[(F.col("own").alias(text) if c == text else m[c]) for c in messages.columns], "parent_turn", (F.size(path) - 1).alias("depth"), path.alias("path"), F.size("passages").cast("long").alias("n_passages"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_quotation_links(spark, sf_dir: str) -> DataFrame:
    t = threads(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "turn", "role", "text", "parent_turn", "depth", "path", "n_passages", "n_links")
