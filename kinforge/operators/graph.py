"""Kinship closures: semi-naive frontier loops over edge tables, with the lineage cut each round."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators.checkpoints import cut

#: rounds after which the rows found so far become one piece
MERGE = 8


def edges(nodes: DataFrame) -> DataFrame:
    """``file, src, dst, kind``: famc and fams from persons, husb, wife and chil from families."""
    top = nodes.where(F.col("level") == 0).select("file", "rec", F.col("pointer").alias("src"))
    refs = nodes.where((F.col("level") == 1) & F.col("tag").isin("FAMC", "FAMS", "HUSB", "WIFE", "CHIL")).select("file", "rec", F.col("value").alias("dst"), F.lower("tag").alias("kind"))
    return refs.join(top, ["file", "rec"]).select("file", "src", "dst", "kind")


def parents(e: DataFrame) -> DataFrame:
    """``file, child, parent``."""
    up = e.where("kind = 'famc'").select("file", F.col("src").alias("child"), F.col("dst").alias("fam"))
    spouses = e.where("kind in ('husb', 'wife')").select("file", F.col("src").alias("fam"), F.col("dst").alias("parent"))
    return up.join(spouses, ["file", "fam"]).select("file", "child", "parent").distinct()


def _spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def closure(pairs: DataFrame, seeds: DataFrame, src: str, dst: str, forbidden: DataFrame | None = None, carry: tuple[str, ...] = (), barred: DataFrame | None = None) -> DataFrame:
    """``file, id, depth``: all that is reached from the seeds (file, id), themselves at depth 0.

    Only the last round's new nodes are joined with the edges, and nodes seen before are left out,
    so cycles end. Nobody among ``forbidden`` (file, id) is reached or gone through. Rounds are
    merged every ``MERGE`` of them, so the plan of a deep tree does not grow with its depth.
    Columns of the seeds named by ``carry`` go along: closures of many seeds, kept apart, run as one;
    ``barred`` (file, carried columns, id) is forbidden to some of them. No join is broadcast: what is
    sent to the driver would grow with the reach in every round.
    """
    key = ["file", *carry, "id"]

    def allowed(d: DataFrame) -> DataFrame:
        d = d if forbidden is None else d.join(forbidden.select("file", "id").hint("merge"), ["file", "id"], "left_anti")
        return d if barred is None else d.join(barred.select(*key).hint("merge"), key, "left_anti")

    # read in every round: kept spread by what it is joined by, so that no round shuffles or sorts all edges again
    pairs = pairs.select("file", src, dst).repartition(_spread(seeds.sparkSession), "file", src).sortWithinPartitions("file", src).persist(StorageLevel.MEMORY_AND_DISK)
    seen = cut(allowed(seeds.select(*key).distinct()).select(*key).withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.select("file", *carry, F.col("id").alias(src)).join(pairs.hint("merge"), ["file", src]).select("file", *carry, F.col(dst).alias("id")).distinct()
        frontier = cut(allowed(step).join(seen.hint("merge"), key, "left_anti").select(*key).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            pairs.unpersist()
            return seen
        seen = seen.unionByName(frontier)
        if depth % MERGE == 0:
            seen = cut(seen)


def ancestors(par: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(par, seeds, "child", "parent")


def descendants(par: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(par, seeds, "parent", "child")


def bloodline(par: DataFrame, seeds: DataFrame) -> DataFrame:
    """Descendants of every ancestor."""
    return descendants(par, ancestors(par, seeds))


def siblings(par: DataFrame, seeds: DataFrame) -> DataFrame:
    up = seeds.select("file", F.col("id").alias("child")).join(par, ["file", "child"]).select("file", "parent").distinct()
    return up.join(par, ["file", "parent"]).select("file", F.col("child").alias("id")).distinct().join(seeds.select("file", "id"), ["file", "id"], "left_anti")


def partners(e: DataFrame, seeds: DataFrame) -> DataFrame:
    s = e.where("kind in ('husb', 'wife')").select("file", F.col("src").alias("fam"), F.col("dst").alias("id"))
    own = s.join(seeds.select("file", "id"), ["file", "id"], "left_semi")
    return own.select("file", "fam", F.col("id").alias("me")).join(s, ["file", "fam"]).where("id <> me").select("file", "id").distinct()


def keep(nodes: DataFrame, persons: DataFrame, kept_families: DataFrame | None = None) -> DataFrame:
    """Persons of the set (file, id), families of theirs (those with a member in it, where none is given), and all other records; dangling references go."""
    members = nodes.where((F.col("level") == 1) & (F.col("rec_tag") == "FAM") & F.col("tag").isin("HUSB", "WIFE", "CHIL"))
    fams = members.join(persons.select("file", F.col("id").alias("value")), ["file", "value"], "left_semi").select("file", "rec").distinct()
    heads = nodes.where("level = 0").select("file", "rec", "tag", "pointer")
    people = heads.where("tag = 'INDI'").join(persons.select("file", F.col("id").alias("pointer")), ["file", "pointer"], "left_semi")
    every = heads.where("tag = 'FAM'")
    families = every.join(fams, ["file", "rec"], "left_semi") if kept_families is None else every.join(kept_families.select("file", F.col("id").alias("pointer")), ["file", "pointer"], "left_semi")
    other = heads.where(~F.col("tag").isin("INDI", "FAM"))
    kept = people.unionByName(families.select(*people.columns)).unionByName(other.select(*people.columns))
    out = nodes.join(kept.select("file", "rec"), ["file", "rec"], "left_semi")
    links = F.col("tag").isin("FAMS", "FAMC", "HUSB", "WIFE", "CHIL") & (F.col("level") == 1)
    alive = kept.select("file", F.col("pointer").alias("value")).where("value is not null")
    return out.where(~links).unionByName(out.where(links).join(alive, ["file", "value"], "left_semi").select(*nodes.columns))
