"""Persons and families as nested records, ready for JSON.

A person's entry in a list of parents, partners or children is (id, name, surname, sex,
date_of_birth); lists of partners and children are ordered by year of birth, those without one
last, then by name. Links are those of ``evidence``, sent to birth, death or marriage by what they are
about; ``cache`` holds kinds of links that their paths do not tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.operators import evidence, relational
from kinforge.operators.checkpoints import cut, stored
from kinforge.sources import ged

#: fixed values: kinds of NAME that give other surnames, and elements below a NAME that do
OTHER_NAMES = ("married", "maiden", "aka")
INLINE_SURNAMES = ("_MARNM", "_FORMERNAME")
#: events of a person that are told
LIFE = ("BIRT", "BAPM", "CHR", "DEAT", "BURI")
#: the order of records in a written file
PERSON_ORDER = ("surname", "name", "birth.date", "death.date", "birth.place", "death.place")
FAMILY_ORDER = ("husband.surname", "husband.name", "wife.surname", "wife.name", "marriage.date", "marriage.place")


def _names(n: Column) -> Column:
    """``name, surname, alt_surname`` from the NAMEs of a person in order: the first that is not of another kind, the other surnames after it.

    If there are only names of other kinds, the first of them is the person's name.
    """
    main = F.get(F.filter(n, lambda x: ~x["other"]), F.lit(0))
    others = F.filter(F.transform(F.filter(n, lambda x: x["other"]), lambda x: F.struct(x["first"].alias("first"), F.coalesce(F.nullif(x["surn"], F.lit("")), x["last"]).alias("last"))), lambda x: x["last"] != "")
    own = F.when(main.isNotNull(), F.struct(main["first"].alias("first"), main["last"].alias("last"))).otherwise(F.get(others, F.lit(0)))
    rest = F.when(main.isNotNull(), others).otherwise(F.slice(others, F.lit(2), F.size(others)))
    surnames = F.array_distinct(F.concat(F.transform(rest, lambda x: x["last"]), F.flatten(F.transform(n, lambda x: x["inline"]))))
    surname = F.coalesce(own["last"], F.lit(""))
    return F.struct(F.coalesce(own["first"], F.lit("")).alias("name"), surname.alias("surname"), F.array_join(F.array_remove(surnames, surname), ", ").alias("alt_surname"))


def facts(nodes: DataFrame) -> DataFrame:
    """One row a person: file, rec, id, names, sex, dates and places of birth, baptism, death and burial.

    The records are read and dealt out once, with those of their lines that tell any of it.
    """
    level, tag = F.col("level"), F.col("tag")
    some = (level == 0) & (tag == "INDI") | (level == 1) & tag.isin("NAME", "SEX", *LIFE) | (level == 2) & tag.isin("TYPE", "SURN", "DATE", "PLAC", *INLINE_SURNAMES)
    head = lambda c: F.max(F.when(level == 0, F.col(c))).alias(c)
    rows = nodes.where((F.col("rec_tag") == "INDI") & some).groupBy("rec", "file").agg(head("ord"), head("pointer"), F.array_sort(F.collect_list(F.when(level > 0, F.struct("ord", "parent", "level", "tag", "value")))).alias("l"))
    own = lambda t: F.filter("l", lambda x: (x["level"] == 1) & (x["tag"] == t))
    low = lambda at, *tags: F.filter("l", lambda x: (x["level"] == 2) & (x["parent"] == at) & x["tag"].isin(*tags))
    filled = lambda c: F.coalesce(c, F.lit(""))
    first = lambda some: F.get(some, F.lit(0))
    part = lambda x, i: text.strip(filled(F.get(F.split(filled(x["value"]), "/"), F.lit(i))))
    said = lambda x: filled(text.strip(x["value"]))
    below = lambda x, t: F.get(F.transform(low(x["ord"], t), said), F.lit(0))
    other = lambda x: F.coalesce(F.lower(below(x, "TYPE")).isin(*OTHER_NAMES), F.lit(False))
    inline = lambda x: F.filter(F.transform(low(x["ord"], *INLINE_SURNAMES), said), lambda v: v != "")
    name = lambda x: F.struct(part(x, 0).alias("first"), part(x, 1).alias("last"), other(x).alias("other"), below(x, "SURN").alias("surn"), inline(x).alias("inline"))
    last = lambda t, what: filled(F.try_element_at(low(first(own(t))["ord"], what), F.lit(-1))["value"])
    event = [F.struct(last(t, "DATE").alias("date"), last(t, "PLAC").alias("place")).alias(t) for t in LIFE]
    d = rows.where("ord is not null").select("file", "rec", "ord", filled(F.col("pointer")).alias("id"), F.transform(own("NAME"), name).alias("n"), text.sex_code(filled(first(own("SEX"))["value"])).alias("sex"), *event)
    d = d.withColumn("n", _names(F.col("n")))
    some = lambda t: F.when((F.col(t)["date"] != "") | (F.col(t)["place"] != ""), F.col(t))
    return d.select("file", "rec", "ord", "id", "n.name", "n.surname", "n.alt_surname", "sex", F.col("BIRT").alias("birth"), F.coalesce(some("BAPM"), some("CHR")).alias("baptism"), F.col("DEAT").alias("death"), some("BURI").alias("burial"))


def entry(name: Column | None = None) -> Column:
    return F.struct("id", (F.col("name") if name is None else name).alias("name"), "surname", "sex", F.col("birth.date").alias("date_of_birth"))


def by_birth(people: Column) -> Column:
    """Ordered by year of birth, unknown last, then name; equal ones stay as they stood."""
    year = lambda x: dates.year_four(x["e"]["date_of_birth"])
    keyed = F.transform(people, lambda x: F.struct(year(x).isNull().alias("n"), F.coalesce(year(x), F.lit(0)).alias("y"), x["e"]["name"].alias("name"), x["k"].alias("k"), x["e"].alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def told_of_families(place: str = "no") -> dict[str, Column]:
    """Aggregates over a family's nodes: the last HUSB and WIFE, the place of the first marriage, date and place of the first that has any."""
    level, tag, ord_ = F.col("level"), F.col("tag"), F.col(place)
    own = lambda t: F.when((level == 1) & (tag == t), ord_)
    low = lambda t: F.max_by(F.struct("at", "value"), F.when((level == 2) & (F.col("top") == "MARR") & (tag == t), F.struct(-F.col("at"), ord_)))
    return {"husband": F.max_by("value", own("HUSB")), "wife": F.max_by("value", own("WIFE")), "wed": F.min(own("MARR")), "wed_date": low("DATE"), "wed_place": low("PLAC")}


def _families(nodes: DataFrame) -> DataFrame:
    """``file, rec, ord, fam, husband, wife, marriage_date, marriage_place``: the last HUSB and WIFE of each family, its first marriage.

    Heads that tell it themselves (``told_of_families``) are only read; else the records are read and dealt out once.
    """
    told = told_of_families("ord")
    heads = nodes.where("level = 0 and tag = 'FAM'").select("file", "rec", "ord", F.col("pointer").alias("fam"), *[c for c in told if c in nodes.columns])
    if "husband" not in nodes.columns:
        some = ged.with_top(nodes.where("rec_tag = 'FAM' and level < 3")).where(F.col("tag").isin("HUSB", "WIFE", "MARR") | F.col("tag").isin("DATE", "PLAC") & (F.col("top") == "MARR"))
        heads = heads.join(some.groupBy("rec", "file").agg(*[c.alias(name) for name, c in told.items()]), ["rec", "file"], "left")
    married = [F.when(F.col(f"wed_{c}")["at"] == F.col("wed"), F.col(f"wed_{c}")["value"]).alias(f"marriage_{c}") for c in ("date", "place")]
    return heads.select("file", "rec", "ord", "fam", "husband", "wife", *married)


def _refs(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.where((F.col("level") == 1) & (F.col("tag") == tag)).select("file", "rec", F.col("ord").alias("k"), F.col("value").alias("ref"))


def _parents(children: DataFrame, families: DataFrame, known: DataFrame) -> DataFrame:
    """``file, rec, parents`` for (file, rec, k, ref): husband before wife of each family, in the order of k."""
    both = children.join(families.select("file", F.col("fam").alias("ref"), F.posexplode(F.array("husband", "wife")).alias("i", "id")), ["file", "ref"])
    met = both.join(known.select("file", "id", entry(F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))).alias("e")), ["file", "id"])
    return met.groupBy("file", "rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "i", "e"))), lambda x: x["e"]).alias("parents"))


def _listed(known: DataFrame, own: DataFrame) -> DataFrame:
    """``facts`` with the links of ``evidence.placed``, without those who have no event or link and a name that is private or NN."""
    d = known.join(own, ["file", "rec"], "left")
    says = (F.concat("birth.date", "birth.place", "death.date", "death.place") != "") | F.col("burial").isNotNull() | (F.coalesce(F.size("links"), F.lit(0)) > 0)
    bare = F.lower("name").isin("private", "<private>") | (F.col("name") == "NN") & (F.col("surname") == "")
    return d.where(says | ~bare)


def person_links(nodes: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``file, id, links`` as ``persons`` gives them, without looking up relatives."""
    return _listed(facts(nodes), evidence.placed(evidence.cited(nodes), evidence.no_cache(nodes) if cache is None else cache)).select("file", "id", "links")


def all_links(nodes: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``file, id, links`` as ``persons`` and as ``families`` give them; what both cite is worked out once, and no relatives are looked up."""
    cited, known = cut(evidence.cited(nodes)), cut(facts(nodes))
    own = evidence.placed(cited, evidence.no_cache(nodes) if cache is None else cache)
    d = _families(nodes).join(evidence.of_families(cited), ["file", "rec"], "left")
    wed = known.select("file", "rec", "id").join(own.select("file", "rec", "marriage_links"), ["file", "rec"], "left")
    for who in ("husband", "wife"):
        d = d.join(wed.select("file", F.col("id").alias(who), F.col("marriage_links").alias(f"{who}_wed")), ["file", who], "left")
    return _listed(known, own).select("file", "id", "links"), d.select("file", F.col("fam").alias("id"), _first_links().alias("links"))


def _first_links() -> Column:
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.coalesce(some("links"), some("husband_wed"), some("wife_wed"))


def persons(nodes: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``file, id, name, surname, sex, birth, death, alt_surname, baptism, burial, links, parents_list, partners_list``; absent parts are null.

    Persons without an event or link whose name is private or NN are left out of the list, though
    others may name them as relatives.
    """
    known, families = cut(facts(nodes)), cut(_families(nodes).drop("marriage_date", "marriage_place"))
    first = _refs(nodes, "FAMC").groupBy("file", "rec").agg(F.min(F.struct("k", "ref")).alias("f")).select("file", "rec", "f.k", "f.ref")
    parents = _parents(first, families, known).withColumnRenamed("parents", "parents_list")
    homes = _refs(nodes, "FAMS").join(known.select("file", "rec", F.col("id").alias("me")), ["file", "rec"]).join(families.select("file", F.col("fam").alias("ref"), "husband", "wife"), ["file", "ref"])
    other = F.when(F.col("husband") == F.col("me"), F.col("wife")).when(F.col("wife") == F.col("me"), F.col("husband"))
    met = homes.select("file", "rec", "k", other.alias("id")).join(known.select("file", "id", entry(F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))).alias("e")), ["file", "id"])
    partners = met.groupBy("file", "rec").agg(by_birth(F.collect_list(F.struct("k", "e"))).alias("partners_list"))
    own = evidence.placed(evidence.cited(nodes), evidence.no_cache(nodes) if cache is None else cache)
    d = _listed(known, own).join(parents, ["file", "rec"], "left").join(partners, ["file", "rec"], "left")
    return d.select("file", "id", "name", "surname", "sex", "birth", "death", F.nullif("alt_surname", F.lit("")).alias("alt_surname"), "baptism", "burial", "links", "parents_list", "partners_list", "ord")


def families(nodes: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``file, id, husband, wife, marriage, links, children_list, husband_parents, wife_parents``; a private spouse hides date and place.

    A family without links has those of marriages that stand at its husband, else at its wife.
    """
    cited, known = cut(evidence.cited(nodes)), stored(facts(nodes).select("file", "rec", "id", "name", "surname", "alt_surname", "sex", "birth"))
    wed = evidence.placed(cited, evidence.no_cache(nodes) if cache is None else cache).select("file", "rec", "marriage_links")
    born = _refs(nodes, "CHIL").withColumnRenamed("ref", "id").join(known.select("file", "id", entry(F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))).alias("e")), ["file", "id"])
    children = born.groupBy("rec", "file").agg(by_birth(F.collect_list(F.struct("k", "e"))).alias("children_list"))
    fams = _families(nodes) if "husband" in nodes.columns else stored(_families(nodes))
    parents = _parents(_refs(nodes, "FAMC"), fams, known)
    spouse = F.struct("id", "name", "surname", "sex", F.col("birth.date").alias("date_of_birth"), F.nullif("alt_surname", F.lit("")).alias("alt_surname"))
    each = stored(known.join(parents, ["file", "rec"], "left").join(wed, ["file", "rec"], "left").select("file", "id", spouse.alias("entry"), "parents", "marriage_links"))
    d = fams.join(children, ["rec", "file"], "left").join(evidence.of_families(cited), ["rec", "file"], "left")
    for who in ("husband", "wife"):
        d = d.join(each.select("file", F.col("id").alias(who), F.col("entry").alias(f"{who}_entry"), F.col("parents").alias(f"{who}_parents"), F.col("marriage_links").alias(f"{who}_wed")), ["file", who], "left")
    d = d.withColumn("links", _first_links())
    hidden = F.lit(False)
    for who in ("husband", "wife"):
        for part in ("name", "surname"):
            hidden = hidden | (F.coalesce(F.lower(text.strip(F.col(f"{who}_entry")[part])), F.lit("")) == "private")
    shown = lambda c: F.when(hidden & (F.coalesce(c, F.lit("")) != ""), "<private>").otherwise(F.coalesce(c, F.lit("")))
    marriage = F.struct(shown(F.col("marriage_date")).alias("date"), shown(F.col("marriage_place")).alias("place"))
    return d.select("file", F.col("fam").alias("id"), F.col("husband_entry").alias("husband"), F.col("wife_entry").alias("wife"), marriage.alias("marriage"), "links", "children_list", "husband_parents", "wife_parents", "ord")


def estimated_years(nodes: DataFrame) -> DataFrame:
    """``file, id, year`` for persons without a date of birth, a death or a burial.

    It is the latest of 20 years before a marriage or a child's birth and 40 years after a parent's.
    """
    heads = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec", F.col("pointer").alias("id"))
    births = relational.first_event(relational.events(nodes, ("BIRT",)), "BIRT", "birth").select("rec", "file", "birth_date")
    known, fams = cut(heads.join(births, ["rec", "file"], "left").select("file", "rec", "id", F.coalesce("birth_date", F.lit("")).alias("birth_date"))), cut(_families(nodes).drop("marriage_date", "marriage_place"))
    born = known.select("file", "id", dates.year_four(F.col("birth_date")).alias("y"))
    gone = nodes.where((F.col("level") == 1) & F.col("tag").isin("DEAT", "BURI")).select("file", "rec").distinct()
    asks = known.where("birth_date = ''").join(gone, ["file", "rec"], "left_anti").select("file", "id", "rec")
    pairs = fams.select("file", F.col("rec").alias("f"), "fam", F.explode(F.array("husband", "wife")).alias("id")).where("id is not null")
    wed = relational.first_event(relational.events(nodes, ("MARR",)), "MARR", "marriage").select("file", F.col("rec").alias("f"), dates.year_four(F.col("marriage_date")).alias("y"))
    children = _refs(nodes, "CHIL").select("file", F.col("rec").alias("f"), F.col("ref").alias("child")).join(born.select("file", F.col("id").alias("child"), "y"), ["file", "child"]).select("file", "f", "y")
    down = pairs.join(wed.unionByName(children), ["file", "f"]).select("file", "id", (F.col("y") - 20).alias("y"))
    up = _refs(nodes, "FAMC").join(asks, ["file", "rec"]).select("file", F.col("id").alias("me"), F.col("ref").alias("fam")).join(pairs, ["file", "fam"]).join(born, ["file", "id"]).select("file", F.col("me").alias("id"), (F.col("y") + 40).alias("y"))
    return down.unionByName(up).join(asks, ["file", "id"], "left_semi").groupBy("file", "id").agg(F.max("y").alias("year")).where("year is not null")


def write_json(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A folder for each file with its records in this order, then that of the file, one JSON object a line; absent parts are left out."""
    keys = ["file", *[F.coalesce(F.col(c), F.lit("")) for c in order], "ord"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("ord").write.partitionBy("file").option("ignoreNullFields", "true").json(path)


def counts(people: DataFrame, families_: DataFrame) -> DataFrame:
    """``file, persons_count, families_count, links_count``: records, and those of them with links."""
    some = (F.coalesce(F.size("links"), F.lit(0)) > 0).cast("long")
    both = people.select("file", F.lit(1).alias("p"), F.lit(0).alias("f"), some.alias("l")).unionByName(families_.select("file", F.lit(0).alias("p"), F.lit(1).alias("f"), some.alias("l")))
    return both.groupBy("file").agg(F.sum("p").alias("persons_count"), F.sum("f").alias("families_count"), F.sum("l").alias("links_count"))


def contributor_id(c: Column) -> Column:
    """Each part between hyphens in lower case with a capital first letter."""
    return F.array_join(F.transform(F.split(c, "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "-")
