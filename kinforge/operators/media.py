"""Which links a person or family reaches through media records, and links that several media records share.

From a record the values below it are read, those of events only if asked for. A reference to a media
record (OBJE) is followed, from there to further ones, each once, so circles end; nothing is read below
a reference to any other record of ``FOLLOWED_BY_NOTHING``. Reach is a closure over (root, record)
pairs whose rounds join only what the last one found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators import graph, labels
from kinforge.operators.checkpoints import cut, stored
from kinforge.sources.ged import MAX_LEVEL

#: fixed values: references below which nothing is read
FOLLOWED_BY_NOTHING = ("OBJE", "FAMC", "FAMS", "HUSB", "WIFE", "CHIL", "SOUR", "REPO")
#: fixed values: level-1 elements that are events or attributes
EVENTS = (
    "BIRT", "CHR", "DEAT", "BURI", "CREM", "ADOP", "BAPM", "BARM", "BASM", "BLES", "CHRA", "CONF", "FCOM", "ORDN", "NATU", "EMIG", "IMMI", "CENS", "PROB", "WILL", "GRAD", "RETI", "EVEN",
    "CAST", "DSCR", "EDUC", "IDNO", "NATI", "NCHI", "NMR", "OCCU", "PROP", "RELI", "RESI", "SSN", "TITL", "FACT", "MARS", "DIV", "DIVF", "ENGA", "MARR", "MARB", "MARC", "MARL",
)


def _pointer(c: Column) -> Column:
    return c.rlike(r"(?s)^@[^@]+@\z")


def _web(c: Column) -> Column:
    return F.lower(c).startswith("http://") | F.lower(c).startswith("https://")


def heads(nodes: DataFrame) -> DataFrame:
    """``file, value, target``: records by pointer; of several with one pointer the last."""
    return nodes.where((F.col("level") == 0) & (F.coalesce("pointer", F.lit("")) != "")).groupBy("file", F.col("pointer").alias("value")).agg(F.max("rec").alias("target"))


def readable(nodes: DataFrame) -> DataFrame:
    """``file, rec, rec_tag, tag, value, top``: links and media references that stand below no other reference; ``top`` is the tag of the record's own element that they are or stand below.

    What stands above a node is the latest node of each level in its record, which one window tells without a join; so nodes need no path.
    """
    value = text.strip(F.coalesce("value", F.lit("")))
    d = nodes.select("file", "rec", "ord", "level", "tag", "rec_tag", value.alias("value")).withColumn("points", _pointer(F.col("value")))
    gives = _web(F.col("value")) | (F.col("tag") == "OBJE") & F.col("points")
    shut = F.col("tag").isin(*FOLLOWED_BY_NOTHING) & F.col("points")
    d = d.select("file", "rec", "ord", "level", "rec_tag", F.when(gives, F.col("value")).alias("value"), F.struct("tag", shut.alias("shut")).alias("own"))
    so_far = W.partitionBy("rec", "file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("line", F.array(*[F.last(F.when(F.col("level") == k, F.col("own")), True).over(so_far) for k in range(MAX_LEVEL + 1)]))
    below = lambda n: F.filter(F.slice("line", F.lit(2), F.greatest(n, F.lit(0))), lambda x: x.isNotNull())
    d = d.where((F.col("level") > 0) & F.col("value").isNotNull() & F.get("line", F.lit(0)).isNotNull() & ~F.exists(below(F.col("level") - 1), lambda x: x["shut"]))
    return d.select("file", "rec", "rec_tag", F.col("own.tag").alias("tag"), "value", F.get(below(F.col("level")), F.lit(0))["tag"].alias("top"))


def reach(read: DataFrame, index: DataFrame, include_events: bool = True) -> DataFrame:
    """``file, root, rec, event``: records that each person or family reaches through media references, itself left out unless it refers to itself, and whether the way begins at an event; where ways of both kinds lead to one there are two rows."""
    refs = stored(read.where(F.col("tag") == "OBJE").join(index.hint("merge"), ["file", "value"]).select("file", "rec", "rec_tag", "top", "target"))
    seeds = refs.where(_own(include_events)).select("file", F.col("rec").alias("root"), F.col("top").isin(*EVENTS).alias("event"), F.col("target").alias("id"))
    found = graph.closure(refs.select("file", "rec", "target").distinct(), seeds, "rec", "target", carry=("root", "event"))
    return found.select("file", "root", F.col("id").alias("rec"), "event")


def _own(include_events: bool) -> Column:
    return F.col("rec_tag").isin("INDI", "FAM") & (F.lit(include_events) | ~F.col("top").isin(*EVENTS))


def found(nodes: DataFrame, include_events: bool = True) -> DataFrame:
    """``file, rec, url, event``: values that are links, of persons and families and of what they reach, and whether they are reached from an event; several searches can share them."""
    read = stored(readable(nodes))
    links = read.where(_web(F.col("value"))).withColumnRenamed("value", "url")
    own = links.where(_own(include_events)).select("file", "rec", "url", F.col("top").isin(*EVENTS).alias("event"))
    there = links.select("file", "rec", "url").distinct()
    via = reach(read, heads(nodes), include_events).join(there.hint("merge"), ["file", "rec"]).select("file", F.col("root").alias("rec"), "url", "event")
    return own.unionByName(via).distinct()


def search(nodes: DataFrame, pattern: str = "", include_events: bool = True, only: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """``file, rec, url``: values that are links and hold the pattern, of persons and families and of what they reach.

    ``only`` (file, rec) restricts the persons, not the families. ``every`` is what is ``found`` with events, where several searches share it.
    """
    every = found(nodes, include_events) if every is None else every
    holds = F.contains(F.lower("url"), F.lit(pattern.lower())) & (F.lit(include_events) | ~F.col("event"))
    every = every.where(holds).select("file", "rec", "url").distinct()
    if only is None:
        return every
    families = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).select("file", "rec")
    return every.join(only.select("file", "rec").unionByName(families), ["file", "rec"], "left_semi")


def shared_files(nodes: DataFrame) -> DataFrame:
    """``file, url, media, rec``: links that are the FILE of several media records, with those records and all persons and families that refer to them anywhere; rec is null where none does."""
    files = nodes.where((F.col("rec_tag") == "OBJE") & (F.col("level") == 1) & (F.col("tag") == "FILE")).select("file", "rec", "ord", text.strip(F.coalesce("value", F.lit(""))).alias("value")).where(_web(F.col("value")))
    own = nodes.where("level = 0 and rec_tag = 'OBJE'").select("file", "rec", F.coalesce("pointer", F.lit("")).alias("media"))
    d = files.join(own, ["file", "rec"]).withColumn("key", F.lower("value"))
    many = d.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ord").alias("url")).where("n > 1")
    refs = nodes.where(F.col("rec_tag").isin("INDI", "FAM") & (F.col("level") > 0) & (F.col("tag") == "OBJE")).select("file", F.col("rec").alias("by"), text.strip(F.coalesce("value", F.lit(""))).alias("media"))
    refs = refs.where(F.col("media").startswith("@") & F.col("media").endswith("@")).distinct()
    return many.select("file", "key", "url").join(d.select("file", "key", "media").distinct(), ["file", "key"]).join(refs, ["file", "media"], "left").select("file", "url", "media", F.col("by").alias("rec"))


def registers(value: Column) -> Column:
    """A value's links to parish registers, whatever the case of their letters."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"""(?iU)https?://[^\s'"<>\]]+"""), F.lit(0))


def listed_registers(records: DataFrame) -> DataFrame:
    """Distinct ``url``: register links in the text columns of records, and in those of lists of texts; what is nested deeper is not read."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    texts = [F.array(f"`{c}`") for c, k in kinds.items() if k == "string"] + [F.coalesce(F.col(f"`{c}`"), F.array().cast("array<string>")) for c, k in kinds.items() if k == "array<string>"]
    if not texts:
        return records.sparkSession.createDataFrame([], "url string")
    found = F.flatten(F.transform(F.concat(*texts), registers))
    return records.select(F.explode(found).alias("url")).where(_is_register(F.col("url"))).distinct()


def _is_register(url: Column) -> Column:
    host, path = (F.regexp_extract(url, r"(?is)^https?://([^/]*)(.*)", i) for i in (1, 2))
    folders = F.slice(F.split(path, "/"), 2, 5)
    return F.lower(host).isin("data.matricula-online.eu", "matricula-online.eu") & (F.size(folders) == 5) & F.forall(folders, lambda x: x != "")


def provenance(nodes: DataFrame) -> DataFrame:
    """``file, rec, ord, i, url``: register links in a person's or family's own values, and in any record that it refers to by any tag."""
    d = nodes.where((F.col("level") > 0) & ~F.col("tag").isin("CONC"))
    joined = nodes.where("tag = 'CONC'").groupBy("file", F.col("parent").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]), "").alias("more"))
    said = d.join(joined, ["file", "ord"], "left").withColumn("value", F.concat(F.coalesce("value", F.lit("")), F.coalesce("more", F.lit(""))))
    urls = said.select("file", "rec", "rec_tag", "ord", F.posexplode(F.filter(registers(F.col("value")), _is_register)).alias("i", "url"))
    own = F.col("rec_tag").isin("INDI", "FAM")
    there = urls.where(~own).groupBy("file", F.col("rec").alias("target"), "url").agg(F.min(F.struct("ord", "i")).alias("i"))
    refs = said.where(own).select("file", "rec", "ord", text.strip(F.col("value")).alias("value")).where(_pointer(F.col("value"))).join(heads(nodes), ["file", "value"])
    place = F.struct(F.col("ord"), F.col("i"))
    return urls.where(own).select("file", "rec", "ord", place.alias("i"), "url").unionByName(refs.join(there, ["file", "target"]).select("file", "rec", "ord", "i", "url"))


def _names(nodes: DataFrame) -> DataFrame:
    """``file, rec, person, family``: persons by pointer, name and years, families by pointer and the names of the last husband and wife."""
    people = labels.person_labels(nodes).withColumn("name", F.regexp_replace("label", r"[(]b[.](\d+) d[.](\d+)[)]\z", "(b.$1, d.$2)"))
    persons = people.select("file", "rec", F.concat(F.lit("INDI "), F.coalesce("ptr", F.lit("")), F.lit(" — "), "name").alias("person"), F.lit(None).cast("string").alias("family"))
    refs = nodes.where((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE")).select("file", "rec", "ord", "tag", text.strip(F.coalesce("value", F.lit(""))).alias("value"))
    known = refs.join(heads(nodes), ["file", "value"], "left").join(people.select("file", F.col("rec").alias("target"), "name"), ["file", "target"], "left")
    last = lambda tag: F.max_by(F.coalesce("name", "value"), F.when(F.col("tag") == tag, F.col("ord")))
    pairs = known.groupBy("file", "rec").agg(F.concat_ws(" / ", last("HUSB"), last("WIFE")).alias("pair"))
    top = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).select("file", "rec", F.col("pointer").alias("ptr")).join(pairs, ["file", "rec"], "left")
    return persons.unionByName(top.select("file", "rec", F.lit(None).cast("string").alias("person"), F.concat(F.lit("FAM  "), F.coalesce("ptr", F.lit("")), F.lit(" — "), F.coalesce("pair", F.lit(""))).alias("family")))


def audit(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """``file, url, label, at``: register links whose key is not among the listed (file, url), once for each record that has them.

    ``at`` is where the record has the link first, so a link's labels can be read in the order of the
    file; ``url`` is the form that stands first. Rows are kept apart, as a link may have any number of records.
    """
    found = provenance(nodes).withColumn("key", text.url_key(F.col("url")))
    missing = found.join(listed.select("file", text.url_key(F.col("url")).alias("key")).distinct(), ["file", "key"], "left_anti")
    each = cut(missing.groupBy("file", "key", "rec").agg(F.min(F.struct("ord", "i", "url")).alias("first")))
    forms = each.groupBy("file", "key").agg(F.min("first").alias("form"))
    label = F.coalesce("person", "family")
    whole = _names(nodes)
    return each.join(forms, ["file", "key"]).join(whole, ["file", "rec"]).select("file", F.col("form.url").alias("url"), label.alias("label"), F.col("first.ord").alias("at"))
