"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Each source has a weight; the mix is ``share`` times all words. A source's target stops at
``cap`` times its size and what it leaves is shared again by weight. Targets become numbers of
equal-token blocks by highest quotients weight / (2k + 1), first over sources and then over each
source's shards, so that every (source, shard) has an integer quota. A block has ``block`` words,
or so many fewer that the least target still has ``LEAST_BLOCKS`` of them (one word at least).
Inside a shard the documents stand in the order of a seeded hash and their words form one run;
the quota's words, from a seeded block's start on, round the run, are taken, ``cap`` times the
run at most. Only the cut documents at the ends of that range are taken in part.

Defined cases: null or blank texts have size 0 and nothing is taken; null sources form one source
that comes last; repeated rows are documents of their own; an empty table gives an empty result.
Columns other than key, text and source are not read, whatever their names. The targets are worked
out in one task over one row a source, never over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, no_null, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
LEAST_BLOCKS = 64
SHARD_WORDS = 100_000
MAX_SHARDS = 4096
CAP = 2
SHARE = 1.5
SEED = 20240229
#: most sources whose rows are broadcast; the salts that a source is dealt out over beyond it
SIDE_LIMIT, SALTS = 100_000, 64


def word_count(text: Column) -> Column:
    return F.regexp_count(no_null(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, weight`` to those and ``target``: weights filled up to the caps.

    One row for each source. In order of cap / weight, the sources up to some point stand at
    their caps and the rest share what is left by weight; that point is the first at which the
    common level stays below the next source's ratio.
    """
    whole = W.partitionBy()
    order = W.orderBy("ratio", "weight", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(order), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left_weight"))
    s = s.withColumn("level", (-F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", -F.col("level")))).over(whole)["col2"]))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """Adds ``quota``: the group's ``seats`` dealt to its rows by the highest quotients votes / (2k + 1).

    Rounding the exact shares gives every row a quota that the method allows for some divisor;
    the seats that are then short or over, fewer than the rows of the group, go or come by the
    next quotients. A row can win or lose at most 2 + its part of them, so only so many quotients
    of it are ranked. Ties go to the first in the order ``tie``.
    """
    g = W.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    part = F.col(votes).cast("double") / F.col("_all")  # votes times seats may be beyond a long
    share = F.when(F.col("_all") > 0, F.col(seats) * part).otherwise(F.lit(0.0))
    p = p.withColumn("_base", F.floor(share + F.lit(0.5)).cast("long"))
    p = p.withColumn("_short", F.when(F.col("_all") > 0, F.col(seats)).otherwise(0) - F.sum("_base").over(g))
    reach = (F.lit(2) + F.ceil(F.col("_n") * F.col(votes).cast("double") / F.when(F.col("_all") > 0, F.col("_all")))).cast("int")
    steps = F.when(F.col(votes) > 0, F.sequence(F.lit(0), F.coalesce(reach, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    k = F.explode_outer(F.when(F.col("_short") != 0, steps))
    c = p.withColumn("_k", k)
    place = F.when(F.col("_short") > 0, F.col("_base") + F.col("_k")).otherwise(F.col("_base") - 1 - F.col("_k"))
    c = c.withColumn("_place", F.when(place >= 0, place))
    c = c.withColumn("_quotient", F.col(votes) / (2 * F.col("_place") + 1))
    gain = F.when(F.col("_short") > 0, F.col("_quotient")).otherwise(-F.col("_quotient"))
    c = c.withColumn("_rank", F.row_number().over(g.orderBy(gain.desc_nulls_last(), *tie, F.col("_k"))))
    moved = F.when(F.col("_quotient").isNotNull() & (F.col("_rank") <= F.abs("_short")), F.signum("_short")).otherwise(0)
    own = [x for x in parties.columns]
    return c.groupBy(*own, "_base").agg(F.sum(moved).cast("long").alias("_moved")).select(*own, (F.col("_base") + F.col("_moved")).alias("quota"))


def draw(seed: int, key: str, text: str) -> Column:
    """The seeded hash by which documents stand in their shard."""
    return F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text)))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row a document: key, size, source_size, target, taken and the ranges of words taken.

    ``whole`` counts how often all words are taken; ``parts`` lists ranges [start, end) of the
    document's words that are taken once more.
    """
    size = word_count(F.col(text))
    # the words are counted once; sizes without texts are all that is kept
    d = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), draw(seed, key, text).alias("_h")))
    # at most MAX_SHARDS rows of a source meet in its second apportionment; larger sources get larger shards
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))).cast("int")
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    goal = targets(listed, share, cap).withColumn("n_shards", shards).withColumn("_g", F.lit(0))
    goal = goal.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / LEAST_BLOCKS))).cast("long"))
    goal = goal.withColumn("blocks", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    goal = sainte_lague(goal, ["_g"], "target", "blocks", [F.col("source").asc_nulls_last()])
    goal = cut(goal.select("source", "source_size", "target", "n_shards", "block", F.col("quota").alias("source_quota"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_s")))
    d = d.withColumn("_s", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    goal = goal.drop("source")
    if goal.count() <= SIDE_LIMIT:  # one row of seven numbers a source
        d = d.join(F.broadcast(goal), "_s")
    else:  # a large source is dealt out by salt
        salted = goal.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        d = d.withColumn("_salt", F.pmod("_h", F.lit(SALTS))).join(salted, ["_s", "_salt"]).drop("_salt")
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("n_shards")))
    per_shard = d.groupBy("_s", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota"), F.max("block").alias("_block"))
    quota = sainte_lague(per_shard, ["_s"], "shard_size", "source_quota", [F.col("shard")]).select("_s", "shard", "shard_size", "_block", "quota")
    # dealt out by shard: the join's partitioning by source would keep a large source in one task
    d = d.repartition("_s", "shard")
    run = W.partitionBy("_s", "shard").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(run)).withColumn("_begin", F.col("_end") - F.col("size"))
    d = d.join(quota, ["_s", "shard"])
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("_block")))
    words, run_words = F.least(F.col("quota") * F.col("_block"), F.col("shard_size") * cap), F.greatest(F.lit(1), F.col("shard_size"))
    full = F.floor(words / run_words)
    once = words % run_words
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "_s", "shard"), n) * F.col("_block")
    d = d.select("doc_id", "_h", "size", "source_size", "target", "_begin", "_end", "shard_size", full.cast("long").alias("whole"), start.alias("_a"), (start + once).alias("_b"))
    # the range [a, b) goes round the shard's run of words: its second part starts at 0 again

    def part(a: Column, b: Column) -> Column:
        return F.struct((F.greatest(a, F.col("_begin")) - F.col("_begin")).alias("start"), (F.least(b, F.col("_end")) - F.col("_begin")).alias("end"))

    parts = F.array(part(F.col("_a"), F.least("_b", "shard_size")), part(F.lit(0), F.col("_b") - F.col("shard_size")))
    parts = F.when(F.col("whole") < cap, F.filter(parts, lambda p: p["end"] > p["start"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    d = d.withColumn("parts", parts)
    taken = F.col("whole") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda x, p: x + p["end"] - p["start"])
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "whole", "parts", F.col("_h").alias("draw"))


def mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each time a text, or a range of its words, is taken.

    Rows are met by key and ``draw``, so rows without a key are not one group; rows that agree in
    both are equal and are only counted off.
    """
    same = W.partitionBy("_key", "_draw").orderBy("_draw")
    rounds = F.concat(F.transform(F.array_repeat(F.lit(0), F.col("whole").cast("int")), lambda _: F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))), F.col("parts"))
    chosen = plan.select(F.coalesce("doc_id", F.lit(-1)).alias("_key"), F.col("draw").alias("_draw"), "size", rounds.alias("_rounds")).withColumn("_n", F.row_number().over(same)).where(F.size("_rounds") > 0)
    own = docs.select(F.struct(*docs.columns).alias("_d"), F.coalesce(F.col(key), F.lit(-1)).alias("_key"), draw(seed, key, text).alias("_draw")).withColumn("_n", F.row_number().over(same))
    joined = own.join(chosen, ["_key", "_draw", "_n"]).select("_d", "size", F.explode("_rounds").alias("_p"))
    words = F.slice(F.regexp_extract_all(F.col("_d")[text], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), (F.col("_p.start") + 1).cast("int"), (F.col("_p.end") - F.col("_p.start")).cast("int"))
    whole = (F.col("_p.start") == 0) & (F.col("_p.end") == F.col("size"))
    return joined.select(*[(F.when(whole, F.col("_d")[c]).otherwise(F.array_join(words, "")) if c == text else F.col("_d")[c]).alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
