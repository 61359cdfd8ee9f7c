"""Rewrites and deletes on the nodes table. Each is a projection or one anti-join; none walks a tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.sources.ged import MAX_LEVEL

NAME_TAGS = ("NAME", "SURN", "GIVN", "NICK", "MARNM", "_MARNM")
TINY = "0.000001"


# -- cleaners: each value is rewritten where the tag matches
def _on(tags: tuple[str, ...], rewrite, only: str | None = None):
    def run(nodes: DataFrame) -> DataFrame:
        hit = F.col("tag").isin(*tags)
        if only:
            hit = hit & (F.col("rec_tag") == only)
        return nodes.withColumn("value", F.when(hit & F.col("value").isNotNull(), rewrite(F.col("value"))).otherwise(F.col("value")))

    return run


def clean_dates(nodes: DataFrame) -> DataFrame:
    """Distinct dates are normalised once; an empty result removes the element with what is below it."""
    found = dates.normalized(nodes.where(F.col("tag") == "DATE").select("file", "ord", F.col("value").alias("raw")), "raw").select("file", "ord", F.col("value").alias("_new"))
    d = nodes.join(found, ["file", "ord"], "left")
    kept = d.withColumn("value", F.coalesce("_new", "value")).select(*nodes.columns)
    return delete_subtrees(kept, found.where("_new = ''").select("file", "ord"))


def clean_name_placeholders(nodes: DataFrame) -> DataFrame:
    """Unknown names become NN; then each SURN below a NAME says what stands between its first and last slash."""
    d = _on(NAME_TAGS, text.clean_name_placeholder)(nodes)
    above = F.last(F.when(F.col("tag") == "NAME", F.struct("ord", "value")), True).over(W.partitionBy("file", "rec").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_n", above)
    below = (F.col("tag") == "SURN") & (F.col("parent") == F.col("_n.ord"))
    surname = text.strip(F.regexp_extract(F.coalesce("_n.value", F.lit("")), "/(.*)/", 1))
    differs = text.strip(F.coalesce("value", F.lit(""))) != surname
    return d.withColumn("value", F.when(below & differs, surname).otherwise(F.col("value"))).select(*nodes.columns)


#: name -> rewrite; they always run in this order
CLEANERS = {
    "dd_mmm_yyyy": clean_dates,
    "name_placeholder": clean_name_placeholders,
    "name_capitalization": _on(NAME_TAGS, text.capitalize_name, "INDI"),
    "name_lower": _on(NAME_TAGS, text.lower_if_shouted, "INDI"),
    "place_placeholder": _on(("PLAC",), text.place_placeholder),
    "place_slovenia_rm": _on(("PLAC",), text.place_without_country),
    "place_duplicate_rm": _on(("PLAC",), text.place_duplicates),
    "place_country_only": _on(("PLAC",), text.place_ends),
}


def in_order(names: list[str]) -> list[str]:
    """The cleaners of these names as they run."""
    unknown = set(names) - set(CLEANERS)
    if unknown:
        raise ValueError(f"unknown cleaners: {sorted(unknown)}")
    return [name for name in CLEANERS if name in names]


def clean(nodes: DataFrame, names: list[str]) -> DataFrame:
    for name in in_order(names):
        nodes = CLEANERS[name](nodes)
    return nodes


# -- what stands above a node: by one window in its record, no join
def _so_far():
    return W.partitionBy("file", "rec").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)


def _above(what: Column, among: Column | None = None) -> Column:
    """``what`` at the latest node of each level, from level 0 to the deepest; ``among`` tells which nodes count."""
    return F.array(*[F.last(F.when(F.col("level") == k if among is None else (F.col("level") == k) & among, what), True).over(_so_far()) for k in range(MAX_LEVEL + 1)])


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_tag, parent_value, grand_tag``; null where there is none."""
    line = F.filter(F.slice("_line", F.lit(1), F.col("level")), lambda x: x.isNotNull())
    d = nodes.withColumn("_line", _above(F.struct("tag", "value"))).withColumn("_line", line)
    up, top = F.get("_line", F.size("_line") - 1), F.get("_line", F.size("_line") - 2)
    return d.select(*nodes.columns, up["tag"].alias("parent_tag"), up["value"].alias("parent_value"), top["tag"].alias("grand_tag"))


def delete_where(nodes: DataFrame, hit: Column) -> DataFrame:
    """Without the nodes that ``hit`` and everything below them."""
    d = nodes.withColumn("_hits", _above(F.coalesce(hit, F.lit(False))))
    return d.where(~F.exists(F.slice("_hits", F.lit(1), F.col("level") + 1), lambda x: F.coalesce(x, F.lit(False)))).drop("_hits")


# -- deletes
def delete_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Without the nodes ``roots`` (file, ord) and everything below them."""
    below = nodes.select("file", "ord", F.explode("path").alias("_a")).join(roots.select("file", F.col("ord").alias("_a")), ["file", "_a"], "left_semi").select("file", "ord")
    return nodes.join(below, ["file", "ord"], "left_anti")


@dataclass(frozen=True)
class Strip:
    """What to delete: tags, their parent's and grandparent's tag, or an exact level; else whole records."""

    tags: tuple[str, ...]
    parent: str | None = None
    grandparent: str | None = None
    level: int | None = None


STRIPS = {
    "stf": Strip(("_STF",)), "sto": Strip(("_STO",), level=1), "stp": Strip(("_STP",), level=1), "bkm": Strip(("_BKM",), level=1), "labl": Strip(("_LABL",), level=1), "mise": Strip(("MISE",), level=1),
    "addr_longlati": Strip(("LATI", "LONG", "MAP"), parent="ADDR"), "place_tran": Strip(("TRAN",), parent="PLAC"), "object_crop": Strip(("CROP",), parent="OBJE"),
    "indi_race": Strip(("RACE",), parent="INDI"), "sour_tags": Strip(("AGNC",), parent="SOUR"), "change_date": Strip(("CHAN",), level=2), "create_date": Strip(("CREA",), level=2),
}


def strip(nodes: DataFrame, spec: Strip) -> DataFrame:
    hit = F.col("tag").isin(*spec.tags)
    if spec.level is not None:
        hit = hit & (F.col("level") == spec.level)
    elif spec.parent is None:
        hit = hit & (F.col("level") == 0)
    if spec.parent is None:
        return delete_where(nodes, hit)
    hit = hit & (F.col("parent_tag") == spec.parent)
    if spec.grandparent is not None:
        hit = hit & (F.col("grand_tag") == spec.grandparent)
    return delete_where(with_parents(nodes), hit).select(*nodes.columns)


#: deletes that ``mark`` can tell without taking anything away
MARKS = {name: (spec,) for name, spec in STRIPS.items()} | {"ste": (Strip(("_STE",)), Strip(("_STE",), parent="SOUR"))}


def mark(nodes: DataFrame, name: str, place: int) -> DataFrame:
    """``_gone`` becomes ``place`` at what this delete takes of the nodes where it is null; only windows over the record."""
    for spec in MARKS[name]:
        there = F.col("_gone").isNull()
        hit = there & F.col("tag").isin(*spec.tags)
        d = nodes
        if spec.level is not None:
            hit = hit & (F.col("level") == spec.level)
        elif spec.parent is None:
            hit = hit & (F.col("level") == 0)
        if spec.parent is not None:
            d = d.withColumn("_line", _above(F.col("tag"), there)).withColumn("_line", F.filter(F.slice("_line", F.lit(1), F.col("level")), lambda x: x.isNotNull()))
            hit = hit & (F.get("_line", F.size("_line") - 1) == spec.parent)
            if spec.grandparent is not None:
                hit = hit & (F.get("_line", F.size("_line") - 2) == spec.grandparent)
        d = d.withColumn("_hits", _above(F.coalesce(hit, F.lit(False)), there))
        lost = there & F.exists(F.slice("_hits", F.lit(1), F.col("level") + 1), lambda x: F.coalesce(x, F.lit(False)))
        nodes = d.withColumn("_gone", F.when(lost, place).otherwise(F.col("_gone"))).select(*nodes.columns)
    return nodes


def strip_marked_records(nodes: DataFrame, tag: str = "PRIV") -> DataFrame:
    """Without the records that have a child of that tag."""
    marked = nodes.where((F.col("level") == 1) & (F.col("tag") == tag)).select("file", "rec").distinct()
    return nodes.join(marked, ["file", "rec"], "left_anti")


def strip_ste(nodes: DataFrame) -> DataFrame:
    """Without _STE records and without _STE below any SOUR."""
    return strip(strip(nodes, Strip(("_STE",))), Strip(("_STE",), parent="SOUR"))


def strip_death_placeholders(nodes: DataFrame, as_of: int) -> DataFrame:
    """Without death events that say nothing: no value, and below them only empty values, dates without digits and places without letters or digits.

    People born a hundred years before ``as_of`` or earlier keep them: there they mean a death at an unknown time.
    """
    value = F.coalesce(text.strip(F.col("value")), F.lit(""))
    top = (F.col("rec_tag") == "INDI") & (F.col("level") == 1)
    event = top & F.col("tag").isin("DEAT", "BURI", "CREM")
    says = (F.col("level") == 2) & (value != "") & ~((F.col("tag") == "DATE") & ~value.rlike(r"\d")) & ~((F.col("tag") == "PLAC") & ~value.rlike("[A-Za-z0-9]"))
    record = W.partitionBy("file", "rec")
    year = F.when((F.col("tag") == "DATE") & (F.col("level") == 2) & F.col("parent_tag").isin("BIRT", "BAPM", "CHR"), dates.birth_year(value))
    born = F.coalesce(F.max_by(F.when(F.col("parent_tag") == "BIRT", year), F.when((F.col("parent_tag") == "BIRT") & year.isNotNull(), F.col("ord"))).over(record), F.min_by(year, F.when(year.isNotNull(), F.col("ord"))).over(record))
    d = with_parents(nodes).withColumn("_event", F.last(F.when(F.col("level") == 1, F.col("ord")), True).over(_so_far()))
    d = d.withColumn("_old", F.coalesce(F.lit(as_of) - born >= 100, F.lit(False))).withColumn("_says", F.max(says).over(W.partitionBy("file", "rec", "_event")))
    return delete_where(d, event & (value == "") & ~F.col("_old") & ~F.col("_says")).select(*nodes.columns)


def real_names(nodes: DataFrame) -> DataFrame:
    """``file, rec`` of the persons with a name other than NN."""
    real = ~F.upper(F.regexp_replace(F.coalesce("value", F.lit("")), r"[/\s.]", "")).isin("", "NN", "NNNN")
    return nodes.where((F.col("rec_tag") == "INDI") & (F.col("level") == 1) & (F.col("tag") == "NAME") & real).select("file", "rec").distinct()


def strip_nameless(nodes: DataFrame) -> DataFrame:
    """Without persons who have no name but NN."""
    named = real_names(nodes)
    nameless = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).select("file", "rec").join(named, ["file", "rec"], "left_anti")
    return nodes.join(nameless, ["file", "rec"], "left_anti")


def strip_empty_families(nodes: DataFrame) -> DataFrame:
    """Without families none of whose spouses is a person of the file with a real name."""
    persons = nodes.where((F.col("level") == 0) & (F.col("tag") == "INDI")).join(real_names(nodes), ["file", "rec"], "left_semi").select("file", F.col("pointer").alias("value"))
    kept = nodes.where((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE")).join(persons, ["file", "value"], "left_semi").select("file", "rec").distinct()
    empty = nodes.where((F.col("level") == 0) & (F.col("tag") == "FAM")).select("file", "rec").join(kept, ["file", "rec"], "left_anti")
    return nodes.join(empty, ["file", "rec"], "left_anti")


# -- transformers
RENAMES = {"fid_fsftid": ("_FID", "_FSFTID", None), "nobi_fact": ("NOBI", "FACT", None), "sour_filn_abbr": ("FILN", "ABBR", None), "latr_even": ("LATR", "EVEN", "Land Transaction"), "prs_even_type": ("_PRS", "EVEN", "Civil Partnership")}


def rename(nodes: DataFrame, old: str, new: str, kind: str | None = None) -> DataFrame:
    """Another tag; with ``kind`` a first child TYPE is put in."""
    out = nodes.withColumn("tag", F.when(F.col("tag") == old, new).otherwise(F.col("tag")))
    if kind is None:
        return out
    at = (F.col("ord") + F.lit(TINY).cast("decimal(20,6)")).cast("decimal(20,6)")
    made = nodes.where(F.col("tag") == old).select("file", "rec", at.alias("ord"), F.col("ord").alias("parent"), (F.col("level") + 1).alias("level"), F.lit(None).cast("string").alias("pointer"), F.lit("TYPE").alias("tag"), F.lit(kind).alias("value"), "rec_tag", F.concat("path", F.array(at)).alias("path"))
    return out.unionByName(made)


def address_to_place(nodes: DataFrame) -> DataFrame:
    """PLAC becomes the sibling ADDR and the rest of PLAC, whose first part goes if ADDR holds it; ADDR goes."""
    addr = nodes.where((F.col("tag") == "ADDR") & F.col("parent").isNotNull()).groupBy("file", "parent").agg(F.min_by("value", "ord").alias("_addr"), F.min("ord").alias("_at"), F.min_by(F.struct("rec", "level", "rec_tag", "path"), "ord").alias("_like"))
    parts = text.place_parts(F.col("value"))
    rest = F.when(F.contains(F.lower("_addr"), F.lower(F.element_at(parts, 1))), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    joined = F.concat_ws(", ", F.nullif("_addr", F.lit("")), F.nullif(F.array_join(F.filter(rest, lambda x: x != ""), ", "), F.lit("")))
    d = nodes.join(addr, ["file", "parent"], "left")
    d = d.withColumn("value", F.when((F.col("tag") == "PLAC") & F.col("_addr").isNotNull(), joined).otherwise(F.col("value"))).select(*nodes.columns)
    has = nodes.where(F.col("tag") == "PLAC").select("file", "parent").distinct()
    at = (F.col("_at") - F.lit(TINY).cast("decimal(20,6)")).cast("decimal(20,6)")
    made = addr.join(has, ["file", "parent"], "left_anti").where(F.col("_addr") != "").select("file", F.col("_like.rec").alias("rec"), at.alias("ord"), "parent", F.col("_like.level").alias("level"), F.lit(None).cast("string").alias("pointer"), F.lit("PLAC").alias("tag"), F.col("_addr").alias("value"), F.col("_like.rec_tag").alias("rec_tag"), F.concat(F.slice("_like.path", F.lit(1), F.size("_like.path") - 1), F.array(at)).alias("path"))
    return delete_subtrees(d, nodes.where(F.col("tag") == "ADDR").where(F.col("parent").isNotNull()).select("file", "ord")).unionByName(made.select(*nodes.columns))


def source_title(nodes: DataFrame, old: str = "PERI", new: str = "TITL") -> DataFrame:
    """In source records without ``new`` the first ``old`` becomes it."""
    top = nodes.where((F.col("rec_tag") == "SOUR") & (F.col("level") == 1))
    first = top.groupBy("file", "rec").agg(F.min(F.when(F.col("tag") == old, F.col("ord"))).alias("ord"), F.max(F.col("tag") == new).alias("has")).where(~F.col("has") & F.col("ord").isNotNull())
    return nodes.join(first.select("file", "ord", F.lit(True).alias("_hit")), ["file", "ord"], "left").withColumn("tag", F.when(F.col("_hit"), new).otherwise(F.col("tag"))).select(*nodes.columns)


def source_date(nodes: DataFrame) -> DataFrame:
    hit = (F.col("rec_tag") == "SOUR") & (F.col("level") == 1) & (F.col("tag") == "DATE")
    return nodes.withColumn("tag", F.when(hit, "PUBL").otherwise(F.col("tag")))


def second_given_name(nodes: DataFrame) -> DataFrame:
    """SECG below a NAME goes behind its first GIVN, or becomes one; a name whose first SECG is blank stays as it is."""
    value = F.coalesce(text.strip(F.col("value")), F.lit(""))
    below = with_parents(nodes).where(F.col("parent_tag") == "NAME")
    first = lambda tag, what: F.min_by(what, F.when(F.col("tag") == tag, F.col("ord")))
    found = below.groupBy("file", "rec", "parent").agg(first("SECG", value).alias("_second"), F.min(F.when(F.col("tag") == "GIVN", F.col("ord"))).alias("_givn"), F.max("rec_tag").alias("_rec_tag"), F.min("level").alias("_level"), F.min_by("path", "ord").alias("_path"))
    found = found.where(F.coalesce("_second", F.lit("")) != "")
    d = nodes.join(found.select("file", "parent", "_second", "_givn"), ["file", "parent"], "left")
    d = d.withColumn("value", F.when(F.col("ord") == F.col("_givn"), text.strip(F.concat(value, F.lit(" "), F.col("_second")))).otherwise(F.col("value")))
    kept = delete_where(d, F.col("_second").isNotNull() & (F.col("tag") == "SECG")).select(*nodes.columns)
    at = (F.col("parent") + F.lit(TINY).cast("decimal(20,6)")).cast("decimal(20,6)")
    made = found.where(F.col("_givn").isNull()).select("file", "rec", at.alias("ord"), "parent", F.col("_level").alias("level"), F.lit(None).cast("string").alias("pointer"), F.lit("GIVN").alias("tag"), F.col("_second").alias("value"), F.col("_rec_tag").alias("rec_tag"), F.concat(F.slice("_path", F.lit(1), F.size("_path") - 1), F.array(at)).alias("path"))
    return kept.unionByName(made.select(*nodes.columns))


#: transformers that do more than rename a tag; they run behind those that do, in this order
LATER = {"secg_givn": second_given_name, "addr_to_plac": address_to_place, "sour_peri_titl": source_title, "sour_date_publ": source_date, "sour_plac_auth": lambda n: source_title(n, "PLAC", "AUTH")}


def transforms(names: list[str]) -> list[str]:
    """Tag renames in the order asked for, then the others in their fixed order."""
    unknown = set(names) - set(RENAMES) - set(LATER)
    if unknown:
        raise ValueError(f"unknown transformers: {sorted(unknown)}")
    return [name for name in names if name in RENAMES] + [name for name in LATER if name in names]


def transform(nodes: DataFrame, names: list[str]) -> DataFrame:
    for name in transforms(names):
        nodes = rename(nodes, *RENAMES[name]) if name in RENAMES else LATER[name](nodes)
    return nodes


# -- metrics
def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file, processed, changed, removed`` by node."""
    a = before.select("file", "ord", F.col("tag").alias("t0"), F.col("value").alias("v0"))
    b = after.select("file", "ord", F.col("tag").alias("t1"), F.col("value").alias("v1"), F.lit(True).alias("there"))
    d = a.join(b, ["file", "ord"], "left")
    changed: Column = F.col("there") & (~F.col("t0").eqNullSafe(F.col("t1")) | ~F.col("v0").eqNullSafe(F.col("v1")))
    return d.groupBy("file").agg(F.count(F.lit(1)).alias("processed"), F.count_if(changed).alias("changed"), F.count_if(F.col("there").isNull()).alias("removed"))
