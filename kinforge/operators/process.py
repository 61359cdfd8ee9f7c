"""A whole run over files of nodes: cleaners, then transformers, then deletes, by name or by preset."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators import privacy, tree
from kinforge.operators.checkpoints import cut

INDEX = ("dd_mmm_yyyy", "name_placeholder", "name_lower", "place_placeholder", "place_duplicate_rm")
#: fixed values: named combinations of cleaners, deletes and transformers
PRESETS = {
    "mft_webtrees": {
        "clean": ("dd_mmm_yyyy", "name_placeholder"),
        "strip": ("ste", "stf", "sto", "bkm", "labl", "addr_longlati", "place_tran", "mise", "object_crop", "change_date", "create_date", "indi_race", "sour_tags", "stp"),
        "transform": ("secg_givn", "fid_fsftid", "latr_even", "prs_even_type", "nobi_fact", "sour_peri_titl", "sour_date_publ", "sour_filn_abbr", "sour_plac_auth"),
    },
    "mft_sgi": {"clean": ("place_slovenia_rm",), "strip": ("priv",), "transform": ("addr_to_plac", "living100y_private")},
    "mft_public": {"clean": ("place_country_only",), "strip": ("priv",), "transform": ("living100y_initials", "fam_partner_private")},
    "index_cleanup_sgi": {"clean": INDEX, "strip": ("priv",), "transform": ("died20y_private", "living100y_private", "fam_partner_private")},
    "index_cleanup_cgi": {"clean": INDEX, "strip": ("priv",), "transform": ("living100y_private", "fam_partner_private")},
}
#: transformers that hide people, in their fixed order: name -> (years, form of the name)
LIVING = {"living100y_private": (100, "private"), "living75y_private": (75, "private"), "living100y_initials": (100, "initials"), "living100y_name_only": (100, "name")}
PRIVACY = ("born75y_private", "died20y_private", *LIVING, "fam_partner_private")


def hide(nodes: DataFrame, name: str, as_of: int) -> DataFrame:
    """One transformer that hides people or their families."""
    if name == "fam_partner_private":
        return privacy.private_families(nodes)
    if name in LIVING:
        n, how = LIVING[name]
        hit = cut(privacy.living(nodes, as_of, n, hides_names=how == "private"))
        out = privacy.redact(nodes, hit, how)
        return privacy.without_marriages(out, hit) if how == "initials" else out
    people = privacy.years(nodes)
    return privacy.redact(nodes, people.where({"born75y_private": privacy.born_within, "died20y_private": privacy.died_within}[name](as_of)))


def strip_living(nodes: DataFrame, as_of: int) -> DataFrame:
    """Without the living, and without families a spouse of which is no record of the file any more; families without spouses stay."""
    rest = nodes.join(privacy.strip_living(privacy.years(nodes), as_of), ["file", "rec"], "left_anti")
    alive = rest.where((F.col("level") == 0) & F.col("pointer").isNotNull()).select("file", F.col("pointer").alias("_ref")).distinct()
    refs = rest.where((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE")).select("file", "rec", text.strip(F.coalesce("value", F.lit(""))).alias("_ref"))
    return rest.join(refs.join(alive, ["file", "_ref"], "left_anti").select("file", "rec").distinct(), ["file", "rec"], "left_anti")


def steps(as_of: int, preset: str | None = None, clean: tuple[str, ...] = (), transform: tuple[str, ...] = (), strip: tuple[str, ...] = ()) -> list[tuple[str, str, Callable[[DataFrame], DataFrame]]]:
    """(kind, name, step) of the preset's steps and those named besides, in the order in which they run; unknown names raise an error."""
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {sorted(PRESETS)}")
    own = PRESETS.get(preset, {})
    clean, transform, strip = (tuple(dict.fromkeys((*own.get(kind, ()), *more))) for kind, more in (("clean", clean), ("transform", transform), ("strip", strip)))
    records = {"ste": tree.strip_ste, "noname_indi": tree.strip_nameless, "noname_fam": tree.strip_empty_families, "living": lambda n: strip_living(n, as_of), "priv": tree.strip_marked_records}
    unknown = set(strip) - set(tree.STRIPS) - set(records) - {"deat_placeholder"}
    if unknown:
        raise ValueError(f"unknown deletes: {sorted(unknown)}")
    tags = [t for t in transform if t not in PRIVACY]
    out = [("clean", name, lambda n, x=name: tree.clean(n, [x])) for name in tree.in_order(list(clean))]
    out += [("transform", name, lambda n, x=name: tree.transform(n, [x])) for name in tree.transforms(tags)]
    if "deat_placeholder" in strip:
        out.append(("strip", "deat_placeholder", lambda n: tree.strip_death_placeholders(n, as_of)))
    # each reads what the one before it has hidden
    out += [("privacy", name, lambda n, x=name: cut(hide(n, x, as_of))) for name in PRIVACY if name in transform]
    out += [("strip", name, lambda n, x=name: tree.strip(n, tree.STRIPS[x])) for name in strip if name in tree.STRIPS]
    return out + [("strip", name, step) for name, step in records.items() if name in strip]


def run(nodes: DataFrame, as_of: int, preset: str | None = None, clean: tuple[str, ...] = (), transform: tuple[str, ...] = (), strip: tuple[str, ...] = ()) -> DataFrame:
    """The nodes behind all ``steps``."""
    for _, _, step in steps(as_of, preset, clean, transform, strip):
        nodes = step(nodes)
    return nodes


def counted(nodes: DataFrame, as_of: int, **how) -> tuple[DataFrame, DataFrame]:
    """The nodes behind all ``steps``, and ``file, place, processor, n``: what each has changed in a file, those that change nothing left out.

    Cleaners and tag transformers count the values they change, deletes the elements they take away with all
    below them, and those that hide people the records they touch. Deletes of elements one after another
    are marked in one pass, of which only what they take away is written.
    """
    found, stored = None, False
    for marks, run_ in groupby(enumerate(steps(as_of, **how)), lambda x: x[1][0] == "strip" and x[1][1] in tree.MARKS):
        if not marks:
            for place, (kind, name, step) in run_:
                nodes = nodes if stored else cut(nodes)
                nodes, n, stored = *_step(nodes, place, kind, name, step), True
                found = n if found is None else found.unionByName(n)
            continue
        names = {place: name for place, (_, name, _) in run_}
        marked = nodes.withColumn("_gone", F.lit(None).cast("int"))
        for place, name in names.items():
            marked = tree.mark(marked, name, place)
        lost = cut(marked.where("_gone is not null").select("file", "ord", "parent", F.col("_gone").alias("place")))
        n = lost.join(lost.select("file", F.col("ord").alias("parent"), "place"), ["file", "parent", "place"], "left_anti").groupBy("file", "place").agg(F.count(F.lit(1)).alias("n"))
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        n = n.select("file", "place", named[F.col("place")].alias("processor"), "n")
        found = n if found is None else found.unionByName(n)
        nodes, stored = marked.where("_gone is null").drop("_gone"), False
    if found is None:
        found = nodes.limit(0).select("file", F.lit(0).alias("place"), F.lit("").alias("processor"), F.lit(0).cast("long").alias("n"))
    return nodes, found


def _step(nodes: DataFrame, place: int, kind: str, name: str, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The nodes behind a step, written, and what it has changed."""
    after = cut(step(nodes))
    new = after.select("file", "ord", F.col("tag").alias("_t"), F.col("value").alias("_v"), F.lit(True).alias("_there"))
    d = nodes.select("file", "rec", "ord", "parent", "tag", "value").join(new, ["file", "ord"], "left")
    gone, other = F.col("_there").isNull(), ~F.col("tag").eqNullSafe(F.col("_t")) | ~F.col("value").eqNullSafe(F.col("_v"))
    if kind == "strip":
        lost = d.where(gone)
        n = lost.join(lost.select("file", F.col("ord").alias("parent")), ["file", "parent"], "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    elif kind == "privacy":
        n = d.where(gone | other).groupBy("file").agg(F.countDistinct("rec").alias("n"))
    else:
        n = d.where(gone | other).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return after, n.select("file", F.lit(place).alias("place"), F.lit(name).alias("processor"), "n")


def summary(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each file of the nodes (of which only ``file`` is read) and a row TOTAL, a column for each processor that has changed something, in the order they ran."""
    names = [r["processor"] for r in found.groupBy("processor").agg(F.min("place").alias("place")).orderBy("place").collect()]  # at most as many as there are processors
    every = nodes.select("file").distinct()
    sums = [F.coalesce(F.sum(F.when(F.col("processor") == p, F.col("n"))), F.lit(0)).alias(p) for p in names]
    each = every.join(found, "file", "left").groupBy("file").agg(*(sums or [F.count(F.lit(1)).alias("_")])).select(F.regexp_replace("file", r"(?i)\.ged\z", "").alias("file"), *names)
    total = found.agg(*(sums or [F.count(F.lit(1)).alias("_")])).select(F.lit("TOTAL").alias("file"), *names)
    return each.unionByName(total)


def stem(c: Column) -> Column:
    """File names without their ending, in lower case, as they are compared with a list of wanted ones."""
    return F.lower(F.regexp_replace(c, r"(?i)\.ged\z", ""))


def wanted(files: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files of these names (without ending and regard to case), and ``name`` of those that are missing."""
    asked = files.sparkSession.createDataFrame([(n,) for n in names], "name string").withColumn("_k", F.lower("name"))
    own = files.withColumn("_k", stem(F.col("file")))
    return own.join(F.broadcast(asked.select("_k").distinct()), "_k", "left_semi").select(*files.columns), asked.join(own, "_k", "left_anti").select("name")
