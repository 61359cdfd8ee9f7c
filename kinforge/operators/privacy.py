"""Redaction of living people. Every rule takes ``as_of``, the year to judge by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.operators.checkpoints import cut
from kinforge.operators.relational import DEATH

PRIVATE = "<private>"
MARK = r"(?i)\b(?:living|private|privat)\b"
#: a pass that does not come
NEVER = 1_000_000
FAMILY_EVENTS = ("MARR", "MARB", "MARC", "MARL", "MARS", "EVEN", "ENGA")


def lives(nodes: DataFrame) -> DataFrame:
    """``years`` with the person's pointer ``ptr``: all from the person's own record, first by its level-1 elements, so nothing is joined."""
    level, tag = F.col("level"), F.col("tag")
    value, word = F.coalesce(text.strip(F.col("value")), F.lit("")), F.coalesce("value", F.lit(""))
    top, below, is_date = level == 1, level == 2, (level == 2) & (tag == "DATE")
    marked = tag.isin("NAME", "GIVN", "SURN") & word.rlike(MARK) | (tag == "NOTE") & word.rlike(r"(?i)^(?:living|private|privat)\b")
    # numbers and flags only, and none of what tells nothing: texts would have every record sorted
    d = nodes.where((level == 0) | below | top & tag.isin("BIRT", "BAPM", "CHR", "EVEN", *DEATH) | marked).select(
        "file", "rec", "ord", F.when(top, F.col("ord")).when(below, F.col("parent")).alias("at"), F.when(level == 0, F.col("pointer")).alias("ptr"), ((level == 0) & (tag == "INDI")).alias("person"), marked.alias("marked"),
        (top & (tag == "BIRT")).alias("birth"), (top & tag.isin("BAPM", "CHR")).alias("christened"), (top & tag.isin(*DEATH) & (F.upper(word) != "N")).alias("died"), (top & (F.upper(value) == "Y")).alias("yes"), (top & (tag == "EVEN") & (F.col("rec_tag") == "INDI")).alias("event"),
        is_date.alias("is_date"), F.when(is_date, dates.birth_year(word)).alias("year"), F.when(is_date, dates.year_strict(word)).alias("strict"),
        F.when(below, (value != "") & ((tag != "DATE") | value.rlike(r"\d"))).alias("says"), F.when(below, (tag == "TYPE") & F.lower(value).contains("death")).alias("kind"),
    )
    dated, told = F.when(F.col("is_date"), F.col("ord")), F.when(F.col("year").isNotNull(), F.col("ord"))
    flags = ("person", "marked", "birth", "christened", "died", "yes", "event", "says", "kind")
    d = d.groupBy("rec", "at", "file").agg(
        F.max("ptr").alias("ptr"), *[F.bool_or(c).alias(c) for c in flags], F.bool_or("is_date").alias("dated"),
        F.min_by("strict", dated).alias("exact"), F.max_by("strict", dated).alias("latest"), F.max_by("year", told).alias("last"), F.min_by("year", told).alias("first"),
    )
    known = F.col("yes") | F.coalesce("says", F.lit(True))  # an event with nothing below it counts
    last, first = F.max_by("last", F.when(F.col("birth") & F.col("last").isNotNull(), F.col("at"))), F.min_by("first", F.when(F.col("christened") & F.col("first").isNotNull(), F.col("at")))
    d = d.groupBy("rec", "file").agg(
        F.bool_or("person").alias("person"), F.max("ptr").alias("ptr"), F.coalesce(last, first).alias("birth_year"), F.min_by("exact", F.when(F.col("birth") & F.col("dated"), F.col("at"))).alias("exact_birth"),
        F.min(F.when(F.col("died"), F.col("latest"))).alias("death_year"), F.bool_or(F.col("died") & known | F.col("event") & F.col("kind")).alias("dead"), F.bool_or("marked").alias("marked"),
    )
    return d.where("person").select("file", "rec", "ptr", "birth_year", "exact_birth", "death_year", F.coalesce("dead", F.lit(False)).alias("dead"), F.coalesce("marked", F.lit(False)).alias("marked"))


def years(nodes: DataFrame) -> DataFrame:
    """``file, rec, birth_year, exact_birth, death_year, dead, marked`` for each person."""
    return lives(nodes).drop("ptr")


def born_within(as_of: int, n: int = 75) -> Column:
    return F.coalesce(F.col("birth_year") > as_of - n, F.lit(False))


def died_within(as_of: int, n: int = 20) -> Column:
    by_death = F.col("death_year").isNotNull() & (F.lit(as_of) - F.col("death_year") < n)
    by_birth = F.col("death_year").isNull() & F.col("dead") & (F.lit(as_of) - F.col("exact_birth") < n)
    return F.coalesce(by_death | by_birth, F.lit(False))


def kin(nodes: DataFrame) -> DataFrame:
    """``file, rec, slot, side, other``: each person's parents (p), partners (s) and children (c) by family reference.

    ``slot`` is the node of the person's FAMC or FAMS, ``other`` the record of the relative; of records
    that share a pointer the last counts, and references to no record are left out.
    """
    index = nodes.where((F.col("level") == 0) & (F.coalesce("pointer", F.lit("")) != "")).groupBy("file", "pointer").agg(F.max("rec").alias("rec"))
    refs = nodes.where((F.col("level") == 1) & F.col("tag").isin("FAMC", "FAMS", "HUSB", "WIFE", "CHIL")).select("file", "rec", "rec_tag", "ord", "tag", text.strip(F.coalesce("value", F.lit(""))).alias("pointer"))
    known = cut(refs.join(index.withColumnRenamed("rec", "target"), ["file", "pointer"]))
    homes = known.where((F.col("rec_tag") == "INDI") & F.col("tag").isin("FAMC", "FAMS")).select("file", "rec", F.col("ord").alias("slot"), F.col("tag").alias("home"), F.col("target").alias("fam"))
    members = known.where(F.col("tag").isin("HUSB", "WIFE", "CHIL")).select("file", F.col("rec").alias("fam"), F.when(F.col("tag") == "CHIL", "c").otherwise("s").alias("side"), F.col("target").alias("other"), F.col("pointer"))
    own = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec", F.col("pointer").alias("self"))
    met = homes.join(own, ["file", "rec"]).join(members, ["file", "fam"])
    up, down = (F.col("home") == "FAMC") & (F.col("side") == "s"), (F.col("home") == "FAMS") & ((F.col("side") == "c") | ~F.col("pointer").eqNullSafe(F.col("self")))
    return met.where(up | down).select("file", "rec", "slot", F.when(up, "p").otherwise(F.col("side")).alias("side"), "other")


def living(nodes: DataFrame, as_of: int, n: int = 100, hides_names: bool = True, passes: int = 20) -> DataFrame:
    """``file, rec`` of the living, as passes over each file from its first person to its last would find them.

    Marked persons are living, and those without a death who were born within n years. One without a
    death or a year of birth is living if in some family all parents, some partner or all children are
    hidden at that moment, or if the least estimate by parents (+35) and children (-35), from exact years
    of relatives not hidden yet, lies within n years. Who is hidden loses name and birth for all that
    come later in the same pass, and for everybody from the next pass on.

    The result depends on the order of the persons, yet nothing runs in that order: each person's pass
    follows from the passes of its relatives (hidden for those behind it in the same pass, for those
    before it in the next), so all are worked out together, again and again, until no pass changes.
    That ends, as a pass depends on earlier moments only. Where names stay in part (``hides_names``
    false), hidden relatives no longer count as such, but their births still go.
    """
    people = years(nodes)
    top = nodes.where((F.col("level") == 1) & (F.col("rec_tag") == "INDI") & F.col("tag").isin("NAME", "SURN"))
    said = text.strip(F.coalesce("value", F.lit("")))
    top = top.select("file", "rec", F.when(F.col("tag") == "NAME", F.col("ord")).alias("at"), (F.lower(said) == PRIVATE).alias("private"), ((F.col("tag") == "SURN") & (said != "")).alias("surn"))
    names = top.groupBy("rec", "file").agg(F.coalesce(F.min_by("private", "at"), F.lit(False)).alias("named"), F.bool_or("surn").alias("surn"))
    # numbers before the file's name in what is joined and grouped: sorts tell rows apart by their first key
    d = people.join(names, ["rec", "file"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    recent = ~F.col("dead") & F.coalesce(F.col("birth_year") > as_of - n, F.lit(False))
    skipped = F.col("named") & ~F.coalesce("surn", F.lit(False))
    d = cut(d.select("file", "rec", F.col("exact_birth").alias("y"), "named", (~skipped & (F.col("marked") | recent)).alias("at_once"), (~skipped & ~F.col("marked") & ~F.col("dead") & F.col("birth_year").isNull()).alias("asks")))
    other = d.select("file", F.col("rec").alias("other"), "y", "named", F.col("at_once").alias("other_at_once"))
    links = kin(nodes).join(d.where("asks").select("file", "rec"), ["rec", "file"], "left_semi").join(other, ["other", "file"], "left")
    early = (F.col("other") >= F.col("rec")).cast("int")
    est = F.when(F.col("side") == "p", F.col("y") + 35).when(F.col("side") == "c", F.col("y") - 35)
    links = cut(links.select("file", "rec", "slot", "side", "other", F.coalesce("named", F.lit(False)).alias("named"), F.when(F.col("other_at_once"), 1 + early).alias("gone"), early.alias("early"), (est > as_of - n).alias("good")))
    found = cut(d.where("false").select("file", "rec", F.lit(0).alias("pass")))
    while True:
        gone = F.coalesce("gone", F.col("pass") + F.col("early"))  # the first pass that finds the relative hidden
        seen = links.join(found.withColumnRenamed("rec", "other"), ["other", "file"], "left").withColumn("gone", gone)
        hidden = F.when(F.col("named"), 1).when(F.lit(hides_names), F.col("gone"))
        by_side = seen.groupBy("rec", "slot", "side", "file").agg(
            F.when(F.col("side") == "s", F.min(hidden)).when(F.count(hidden) == F.count(F.lit(1)), F.max(hidden)).alias("short"),
            *[F.max(F.when(F.col("good") == kind, F.coalesce("gone", F.lit(NEVER)))).alias(name) for name, kind in (("old", F.lit(False)), ("young", F.lit(True)))],
        )
        one = by_side.groupBy("rec", "file").agg(F.min("short").alias("short"), F.greatest(F.lit(1), F.max("old")).alias("old"), F.max("young").alias("young"))
        at = F.least("short", F.when(F.col("young") > F.col("old"), F.col("old")))
        new = cut(one.select("file", "rec", at.alias("pass")).where(F.col("pass") <= passes))
        apart = new.join(found.withColumnRenamed("pass", "was"), ["rec", "file"], "full").where(~F.col("pass").eqNullSafe(F.col("was")))
        done, found = apart.isEmpty(), new
        if done:
            return d.where("at_once").select("file", "rec").unionByName(found.select("file", "rec"))


def redact(nodes: DataFrame, people: DataFrame, how: str = "private") -> DataFrame:
    """The people's records keep sex and family links with what is below them, and their first name.

    It is ``<private>``, initials (``initials``) or a given initial with the surname (``name``); a
    record without a name gains one. GIVN and SURN below it stay in the last two forms, shortened
    likewise. With ``whole`` the name stays as it is with all below it, and none is made.
    """
    return redacted(marked(nodes, people), how)


#: what ``marked`` adds to nodes
MARKED = ("_hit", "_top", "_at", "_first")


def marked(nodes: DataFrame, people: DataFrame) -> DataFrame:
    """The nodes with what ``redacted`` asks: whether the record is one of the people's, tag and place of the level-1 element that a node belongs to, and the place of the first name.

    It is the same for every way to hide, so several ways can share it.
    """
    record = W.partitionBy("file", "rec")
    so_far = record.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    d = nodes.join(people.select("file", "rec", F.lit(True).alias("_hit")).distinct(), ["file", "rec"], "left")
    top = lambda c: F.last(F.when(F.col("level") == 1, F.col(c)), True).over(so_far)
    d = d.withColumn("_top", top("tag")).withColumn("_at", top("ord"))
    is_name = F.col("_hit") & (F.col("level") == 1) & (F.col("tag") == "NAME")
    return d.withColumn("_first", F.min(F.when(is_name, F.col("ord"))).over(record)).select(*nodes.columns, *MARKED)


def redacted(d: DataFrame, how: str, make_names: bool = True) -> DataFrame:
    """``redact`` of nodes that are ``marked``; names are made for records without one only if asked for."""
    columns = [c for c in d.columns if c not in MARKED]
    own, part = F.col("ord") == F.col("_first"), (F.col("level") == 2) & (F.col("parent") == F.col("_first"))
    inside = F.col("_at") == F.col("_first") if how == "whole" else F.lit(False)
    value = F.coalesce("value", F.lit(""))
    short = {"private": F.lit(PRIVATE), "initials": text.shorten_name(value), "name": text.shorten_given(value), "whole": F.col("value")}[how]
    kept = {"private": (), "initials": ("GIVN", "SURN"), "name": ("GIVN", "SURN"), "whole": ()}[how]
    cut_short = {"private": (), "initials": ("GIVN", "SURN"), "name": ("GIVN",), "whole": ()}[how]
    stays = F.col("_hit").isNull() | (F.col("level") == 0) | F.col("_top").isin("SEX", "FAMC", "FAMS") | own | inside | part & F.col("tag").isin(*kept)
    new = F.when(own, short).when(F.col("_hit") & part & F.col("tag").isin(*cut_short), text.initials(value)).otherwise(F.col("value"))
    out = d.where(F.coalesce(stays, F.lit(False))).withColumn("value", new).select(*columns)
    if how == "whole" or not make_names:
        return out
    at = (F.col("ord") + F.lit("0.000001").cast("decimal(20,6)")).cast("decimal(20,6)")
    bare = d.where(F.col("_hit") & (F.col("level") == 0) & F.col("_first").isNull())
    made = {"ord": at, "parent": F.col("ord"), "level": F.lit(1), "pointer": F.lit(None).cast("string"), "tag": F.lit("NAME"), "value": F.lit(PRIVATE if how == "private" else ""), "path": F.array(F.col("ord"), at)}
    return out.unionByName(bare.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns]))


def without_death(nodes: DataFrame) -> DataFrame:
    """``file, rec`` of the persons without any death or burial, whatever it says: whom a filtered tree hides."""
    people = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec")
    ended = nodes.where((F.col("level") == 1) & F.col("tag").isin(*DEATH)).select("file", "rec")
    return people.join(ended, ["file", "rec"], "left_anti")


def hide_in_filtered(nodes: DataFrame, how: str) -> DataFrame:
    """A filtered tree with its persons without a death redacted: ``private``, ``initials`` (of given names and surname, none made where there is no name) or ``name`` (the name stays)."""
    return hidden_in_filtered(marked(nodes, without_death(nodes)), how)


def hidden_in_filtered(d: DataFrame, how: str) -> DataFrame:
    """``hide_in_filtered`` of nodes that are ``marked``."""
    if how not in ("private", "initials", "name"):
        raise ValueError(f"unknown way to hide: {how}")
    return redacted(d, {"name": "whole"}.get(how, how), make_names=how == "private")


def without_marriages(nodes: DataFrame, people: DataFrame) -> DataFrame:
    """The families in which these people are partners lose date and place of their marriages."""
    fams = nodes.join(people.select("file", "rec").distinct(), ["file", "rec"], "left_semi").where((F.col("level") == 1) & (F.col("tag") == "FAMS")).select("file", text.strip(F.col("value")).alias("pointer")).distinct()
    recs = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).join(fams, ["file", "pointer"], "left_semi").select("file", "rec", F.lit(True).alias("_fam"))
    from kinforge.operators.tree import delete_where, with_parents

    d = with_parents(nodes).join(recs, ["file", "rec"], "left")
    return delete_where(d, F.col("_fam") & (F.col("level") == 2) & (F.col("parent_tag") == "MARR") & F.col("tag").isin("DATE", "PLAC")).select(*nodes.columns)


def private_families(nodes: DataFrame) -> DataFrame:
    """Families of private spouses only go; those of some private spouse have their events hidden."""
    private = nodes.where((F.col("level") == 1) & (F.col("tag") == "NAME") & (F.col("rec_tag") == "INDI")).groupBy("file", "rec").agg((F.min_by("value", "ord") == PRIVATE).alias("private"))
    heads = nodes.where("level = 0").select("file", "rec", F.col("pointer").alias("value")).join(private, ["file", "rec"]).select("file", "value", "private")
    refs = nodes.where((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE")).select("file", "rec", "value")
    fate = refs.join(heads, ["file", "value"], "left").groupBy("file", "rec").agg(F.bool_and(F.coalesce("private", F.lit(False))).alias("all"), F.bool_or(F.coalesce("private", F.lit(False))).alias("any"))
    d = nodes.join(fate, ["file", "rec"], "left").where(~F.coalesce("all", F.lit(False)))
    event = F.coalesce("any", F.lit(False)) & (F.col("level") == 1) & F.col("tag").isin(*FAMILY_EVENTS)
    from kinforge.operators.tree import delete_subtrees

    hidden = d.withColumn("value", F.when(event & (F.coalesce("value", F.lit("")) != ""), PRIVATE).otherwise(F.col("value"))).select(*nodes.columns, event.alias("_e"))
    below = hidden.where("_e").select("file", F.col("ord").alias("parent"))
    return delete_subtrees(hidden.drop("_e"), hidden.join(below, ["file", "parent"], "left_semi").select("file", "ord"))


def may_live(as_of: int, n: int = 110) -> Column:
    """No death, and born within n years or at an unknown time."""
    return ~F.col("dead") & (F.col("birth_year").isNull() | (F.col("birth_year") > as_of - n))


def strip_living(people: DataFrame, as_of: int, n: int = 110) -> DataFrame:
    """``file, rec`` of people without a death who were born within n years or at an unknown time."""
    return people.where(may_live(as_of, n)).select("file", "rec")
