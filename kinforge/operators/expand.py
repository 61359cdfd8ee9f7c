"""Which persons and families a filter keeps: bloodlines, relatives, siblings and partners of root persons.

Sets are DataFrames of (file, root, id): what is kept for each root, all roots in the same joins and
closures. Every closure ends when nothing new is reached; nobody among the forbidden (file, id) is added
or gone through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators import graph
from kinforge.operators.checkpoints import cut, stored


@dataclass
class Kin:
    """Links between persons and families that both exist: (file, id, fam) each."""

    child_in: DataFrame
    spouse_in: DataFrame
    children: DataFrame
    spouses: DataFrame

    @cached_property
    def up(self) -> DataFrame:
        return self.child_in.withColumnRenamed("id", "child").join(self.spouses.withColumnRenamed("id", "parent"), ["file", "fam"]).select("file", "child", "parent").distinct()

    @cached_property
    def down(self) -> DataFrame:
        return self.spouse_in.withColumnRenamed("id", "parent").join(self.children.withColumnRenamed("id", "child"), ["file", "fam"]).select("file", "parent", "child").distinct()


def kin(nodes: DataFrame) -> Kin:
    heads = nodes.where("level = 0")
    persons = heads.where("tag = 'INDI'").select("file", F.col("pointer").alias("id")).distinct()
    families = heads.where("tag = 'FAM'").select("file", F.col("pointer").alias("fam")).distinct()
    own = F.col("kind").isin("famc", "fams")
    role = F.when(F.col("kind").isin("husb", "wife"), F.lit("spouse")).otherwise(F.col("kind"))
    e = graph.edges(nodes).select("file", role.alias("role"), F.trim(F.when(own, F.col("src")).otherwise(F.col("dst"))).alias("id"), F.trim(F.when(own, F.col("dst")).otherwise(F.col("src"))).alias("fam")).distinct()
    e = stored(e.join(persons, ["file", "id"], "left_semi").join(families, ["file", "fam"], "left_semi"))
    return Kin(*[e.where(F.col("role") == r).select("file", "id", "fam") for r in ("famc", "fams", "chil", "spouse")])


def _union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def _of(links: DataFrame, people: DataFrame) -> DataFrame:
    """The families (file, root, id) that the people are linked to."""
    return people.join(links, ["file", "id"]).select("file", "root", F.col("fam").alias("id")).distinct()


def _in(links: DataFrame, families: DataFrame, forbidden: DataFrame) -> DataFrame:
    """The people linked to the families."""
    members = families.withColumnRenamed("id", "fam").join(links, ["file", "fam"]).select("file", "root", "id").distinct()
    return members.join(forbidden, ["file", "id"], "left_anti").select("file", "root", "id")


def _reached(pairs: DataFrame, people: DataFrame, src: str, dst: str, forbidden: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    return graph.closure(pairs, people, src, dst, forbidden, ("root",), barred).select("file", "root", "id")


def _but(people: DataFrame, others: DataFrame) -> DataFrame:
    return people.join(others, ["file", "root", "id"], "left_anti").select("file", "root", "id")


def related(k: Kin, people: DataFrame, families: DataFrame, stop: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descendants of the people (not through ``stop``), their partners, and the partners' birth families, one level of them."""
    line = _reached(k.down, _but(people, stop), "parent", "child", forbidden, stop)
    homes = _of(k.spouse_in, line)
    partners = cut(_but(_in(k.spouses, homes, forbidden), _union(people, line)))
    births = _of(k.child_in, partners)
    births_members = _union(_in(k.children, births, forbidden), _in(k.spouses, births, forbidden))
    return cut(_union(people, line, partners, births_members)), cut(_union(families, homes, births))


def expanded(k: Kin, roots: DataFrame, forbidden: DataFrame, ancestors: bool = True, descendants: bool = False, with_related: bool = False, related_depth: int = 0, siblings: bool = False, partners: bool = False) -> tuple[DataFrame, DataFrame]:
    """The persons and families (file, root, id) kept for each of the roots (file, id); ``related_depth`` 0 repeats until nothing is added.

    A person found both as a child and as a partner counts as a child, so the result does not
    depend on the order of the search.
    """

    def bloodline(people: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
        if ancestors:
            people = _reached(k.up, people, "child", "parent", forbidden)
            families = _union(families, _of(k.child_in, people))
        if descendants:
            people = _reached(k.down, people, "parent", "child", forbidden)
            families = _union(families, _of(k.spouse_in, people))
        if siblings:
            origin = _of(k.child_in, people)
            people, families = cut(_union(people, _in(k.children, origin, forbidden))), _union(families, origin)
        return people, cut(families)

    own = cut(roots.select("file", F.col("id").alias("root"), "id").distinct())
    people, families = bloodline(own, own.limit(0))
    turn, size = 0, None
    while with_related:
        turn += 1
        size = (people.count(), families.count()) if size is None else size
        stop = own.where(F.lit(not descendants))
        before = people
        people, families = related(k, people, families, stop, forbidden)
        if siblings:
            origin = _of(k.child_in, _but(people, before))
            people, families = cut(_union(people, _in(k.children, origin, forbidden))), _union(families, origin)
        people, families = bloodline(people, families)
        last, size = size, (people.count(), families.count())  # of pieces that are written already
        if turn == related_depth or size == last:
            break
    if partners:
        homes = _of(k.spouse_in, people)
        people, families = cut(_union(people, _in(k.spouses, homes, forbidden))), cut(_union(families, homes))
    return cut(_union(people, _in(k.spouses, families, forbidden))), families


def filtered(nodes: DataFrame, roots: DataFrame, ancestors: bool = True, descendants: bool = False, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons and families (file, id) kept for all roots (file, id), and ``file, id, persons, families`` of each root, with a row TOTAL without a file.

    Only ancestors asked for: the roots' descendants are forbidden; only descendants: their ancestors.
    """
    k = kin(nodes)
    zones = [(not descendants, k.down, "parent", "child"), (not ancestors, k.up, "child", "parent")]
    wanted = cut(roots.select("file", "id").distinct())
    forbidden = wanted.limit(0)
    for closed, pairs, src, dst in zones:
        if closed:
            forbidden = _union(forbidden, graph.closure(pairs, wanted, src, dst).select("file", "id"))
    forbidden = cut(forbidden.join(wanted, ["file", "id"], "left_anti"))
    by_root, homes = expanded(k, wanted, forbidden, ancestors, descendants, **how)
    people, families = by_root.select("file", "id").distinct(), homes.select("file", "id").distinct()
    one = F.lit(1)
    each = by_root.select("file", F.col("root").alias("id"), one.alias("p"), F.lit(0).alias("f")).unionByName(homes.select("file", F.col("root").alias("id"), F.lit(0).alias("p"), one.alias("f")))
    each = each.unionByName(wanted.select("file", "id", F.lit(0).alias("p"), F.lit(0).alias("f")))
    total = people.select(one.alias("p"), F.lit(0).alias("f")).unionByName(families.select(F.lit(0).alias("p"), one.alias("f"))).select(F.lit(None).cast("string").alias("file"), F.lit("TOTAL").alias("id"), "p", "f")
    sums = lambda d: d.groupBy("file", "id").agg(F.sum("p").alias("persons"), F.sum("f").alias("families"))
    return people, families, sums(each).unionByName(sums(total))


def surname_origin(people: DataFrame, up: DataFrame) -> DataFrame:
    """``file, id, place``: a person's own place, else that of the nearest ancestors of the same surname, the least id first.

    ``people`` is (file, id, surname, place), ``up`` (file, child, parent). Level by level, only
    persons without an answer go on, and only through parents with the person's own surname. No
    join is broadcast, as nearly all persons are on both sides.
    """
    known = cut(people.select("file", "id", "surname", F.coalesce("place", F.lit("")).alias("place")))
    found = cut(known.where("place <> ''").select("file", "id", "place"))
    open_ = cut(known.where("place = ''").select("file", F.col("id").alias("who"), "id", "surname"))
    seen = open_.select("file", "who", "id")
    up = cut(up.select("file", F.col("child").alias("id"), "parent"))
    while not open_.isEmpty():
        step = open_.join(up.hint("merge"), ["file", "id"]).select("file", "who", "surname", F.col("parent").alias("id"))
        step = step.join(known.hint("merge"), ["file", "id", "surname"]).select("file", "who", "id", "surname", "place").distinct().join(seen.hint("merge"), ["file", "who", "id"], "left_anti")
        step = cut(step)
        answer = step.where("place <> ''").groupBy("file", F.col("who").alias("id")).agg(F.min_by("place", "id").alias("place"))
        answer = cut(answer.select(*found.columns))
        found = cut(found.unionByName(answer))
        open_ = cut(step.select("file", "who", "id", "surname").join(answer.select("file", F.col("id").alias("who")).hint("merge"), ["file", "who"], "left_anti"))
        seen = cut(seen.unionByName(open_.select(*seen.columns)))
    return known.select("file", "id").join(found.hint("merge"), ["file", "id"], "left").select("file", "id", F.coalesce("place", F.lit("")).alias("place"))
