"""Rows of parish books, fighter lists and grave lists to persons and families.

Every importer is a projection: a row makes its persons side by side, and an explode makes them rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates, records, text


def _cell(df: DataFrame, name: str) -> Column:
    """The trimmed cell, empty where it is null or the column is missing."""
    return records.filled(F.col(name)) if name in df.columns else F.lit("")


def _summary(name: Column, surname: Column, sex: Column, alt: Column) -> Column:
    return F.struct(name.alias("name"), surname.alias("surname"), sex.alias("sex"), alt.alias("alt_surname"))


def _links(url: Column) -> Column:
    return F.when(url != "", F.array(url)).otherwise(F.array().cast("array<string>"))


# -- parish books
def birth_records(rows: DataFrame) -> DataFrame:
    """``id, name, surname, birth, baptism, death, parents_list, links, notes``; an unknown father passes on the mother's surname."""

    def c(n: str) -> Column:
        return _cell(rows, n)

    f, m = records.surname_variants(c("father_surname"), c("father_alt_surname")), records.surname_variants(c("mother_surname"), c("mother_alt_surname"))
    father, mother = records.name_variants(c("father_name")), records.name_variants(c("mother_name"))
    own = records.name_variants(F.coalesce(records.or_null(c("child_name")), c("child_alt_name")))
    d = rows.select(
        c("seq").alias("seq"), c("url").alias("url"), c("notes").alias("notes"), records.parish_place(c("parish"), c("address")).alias("place"),
        records.known_or_nn(own, F.when(F.lower(father) == "ni znan", m["surname"]).otherwise(f["surname"])).alias("child"),
        records.known_or_nn(father, f["surname"]).alias("father"), f["alt"].alias("father_alt"), records.known_or_nn(mother, m["surname"]).alias("mother"), m["alt"].alias("mother_alt"),
        dates.from_iso(c("birth_date")).alias("born"), dates.from_iso(c("baptism_date")).alias("baptism"),
    )
    sides = F.array(*[F.when((F.col(f"{p}.name") != "") | (F.col(f"{p}.surname") != ""), _summary(F.col(f"{p}.name"), F.col(f"{p}.surname"), F.lit(sex), F.col(f"{p}_alt"))) for p, sex in (("father", "m"), ("mother", "f"))])
    return d.select(
        text.stable_id(*[F.col(x) if x != "role" else F.lit("child") for x in ("seq", "url", "role", "child.name", "child.surname", "born", "place")]).alias("id"),
        F.col("child.name").alias("name"), F.col("child.surname").alias("surname"), F.struct(F.col("born").alias("date"), F.col("place")).alias("birth"), "baptism",
        F.coalesce(dates.death_in_notes(F.col("notes")), F.lit("")).alias("death"), F.filter(sides, lambda p: p.isNotNull()).alias("parents_list"), _links(F.col("url")).alias("links"), "notes",
    )


def marriage_records(rows: DataFrame) -> DataFrame:
    """``husband, wife, marriage, links, notes``."""

    def side(p: str, sex: str) -> Column:
        s = records.surname_variants(_cell(rows, f"{p}_surname"), _cell(rows, f"{p}_alt_surname"))
        known = records.known_or_nn(records.name_variants(_cell(rows, f"{p}_name")), s["surname"])
        return _summary(known["name"], known["surname"], F.lit(sex), s["alt"])

    where = records.parish_place(_cell(rows, "parish"), _cell(rows, "address"))
    return rows.select(side("groom", "m").alias("husband"), side("bride", "f").alias("wife"), F.struct(dates.from_iso(_cell(rows, "marriage_date")).alias("date"), where.alias("place")).alias("marriage"), _links(_cell(rows, "url")).alias("links"), _cell(rows, "notes").alias("notes"))


def book_index(rows: DataFrame, file: str = "file", order: str = "row", url: str = "url") -> DataFrame:
    """``file, title, parish, kind, years, n, url`` of each book: its rows and the first link, turned to page 1."""
    link = records.or_null(records.filled(F.col(url)))
    per = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.min_by(link, F.when(link.isNotNull(), F.col(order))).alias("_url"))
    title = F.regexp_replace(F.regexp_extract(F.col(file), r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    return per.select(file, title.alias("title"), records.parish(title).alias("parish"), records.book_kind(F.col(file)).alias("kind"), dates.years_in_title(title).alias("years"), "n", records.first_page(F.coalesce("_url", F.lit(""))).alias("url"))


def whole_files(rows: DataFrame, fits: Column, file: str = "file") -> DataFrame:
    """The rows of files all of whose rows fit; one that does not takes its whole file away."""
    bad = rows.where(~F.coalesce(fits, F.lit(False))).select(file).distinct()
    return rows.join(bad, file, "left_anti")


# -- fighters
def fighter_records(rows: DataFrame, source: str) -> DataFrame:
    """``id, name, surname, alt_surname, birth, death, links, notes`` of rows (row, name, life and what goes to the notes)."""
    d = rows.where(_cell(rows, "name") != "").withColumn("_n", records.name_tokens(F.col("name"))).withColumn("_l", records.life(F.col("life")))
    given = {k: F.col(f"_n.{k}") if k in ("titles", "initials") else F.col(k) for k, _ in records.NOTE_LABELS if k in rows.columns or k in ("titles", "initials")}
    key = text.stable_id(F.col("row"), F.col("_n.surname"), F.col("_n.name"), F.col("_l.birth.date"), F.col("_l.birth.place"))
    return d.select(F.concat(F.lit("zdgm-"), key).alias("id"), F.col("_n.name").alias("name"), F.col("_n.surname").alias("surname"), F.col("_n.alt").alias("alt_surname"), F.col("_l.birth").alias("birth"), F.col("_l.death").alias("death"), F.array(F.lit(source)).alias("links"), records.notes(given).alias("notes"))


# -- graves
def _sides(rows: DataFrame) -> DataFrame:
    """Each row with its ``primary`` and ``partner``, null where there is none."""

    def c(n: str) -> Column:
        return _cell(rows, n)

    d = rows.withColumns({"_note": records.maiden_name(c("note")), "_s1": records.guess_sex(c("prenom")), "_has": (c("prenom_conjoint") != "") | (c("nom_conjoint") != "")})
    d = d.withColumn("_s2", F.when(F.col("_has"), records.guess_sex(c("prenom_conjoint"))).otherwise(""))
    to_partner = F.col("_has") & (F.col("_s1") != "f") & (F.col("_s2") == "f")
    maiden = F.col("_note.maiden")

    def person(role: str, end: str, sex: str, mine: Column, rest: Column) -> Column:
        name, surname = c(f"prenom{end}"), text.title_surname(c(f"nom{end}"))
        return F.struct(
            text.stable_id(F.col("row"), c("depot_id"), F.lit(role), name, surname).alias("id"), F.lit(role).alias("role"), name.alias("name"), surname.alias("surname"), F.col(sex).alias("sex"), F.when(mine, maiden).otherwise("").alias("alt_surname"),
            dates.from_compact(c(f"date_naissance{end}")).alias("birth_date"), dates.from_compact(c(f"date_deces{end}")).alias("death_date"), text.build_place(c("place"), c("nom_projet")).alias("burial_place"), rest.alias("notes"),
        )

    one = F.when((c("prenom") != "") | (c("nom") != ""), person("primary", "", "_s1", ~to_partner, F.col("_note.rest")))
    two = F.when(F.col("_has"), person("partner", "_conjoint", "_s2", to_partner, F.lit("")))
    return d.select("row", c("depot_id").alias("depot_id"), c("nom_projet").alias("cemetery"), c("place").alias("place"), c("type_projet").alias("type"), c("lat").alias("lat"), c("lon").alias("lon"), one.alias("primary"), two.alias("partner"))


def grave_persons(rows: DataFrame) -> DataFrame:
    """One or two persons a row, with their partner's id; rows without a name make none. ``row`` numbers the input's rows."""
    d = _sides(rows).withColumn("p", F.explode(F.filter(F.array("primary", "partner"), lambda x: x.isNotNull())))
    other = F.when(F.col("p.role") == "primary", F.col("partner.id")).otherwise(F.col("primary.id"))
    return d.select("row", "depot_id", "p.*", other.alias("partner_id"))


def grave_families(rows: DataFrame) -> DataFrame:
    """``row, husband, wife`` of rows with two persons: a woman who stands first beside a man is the wife."""
    d = _sides(rows).where("primary is not null and partner is not null")
    turned = (F.col("primary.sex") == "f") & (F.col("partner.sex") == "m")
    return d.select("row", F.when(turned, F.col("partner")).otherwise(F.col("primary")).alias("husband"), F.when(turned, F.col("primary")).otherwise(F.col("partner")).alias("wife"))


def cemetery_stats(rows: DataFrame) -> DataFrame:
    """``cemetery, place, type, lat, lon, persons, families, graves``; the first row with a person gives the details."""
    d = _sides(rows).withColumn("n", F.when(F.col("primary").isNotNull(), 1).otherwise(0) + F.when(F.col("partner").isNotNull(), 1).otherwise(0)).where("n > 0")
    first = F.min_by(F.struct("place", "type", "lat", "lon"), "row").alias("f")
    per = d.groupBy("cemetery").agg(first, F.sum("n").alias("persons"), F.count_if(F.col("n") == 2).alias("families"), F.countDistinct(records.or_null(F.col("depot_id"))).alias("graves"))
    return per.select("cemetery", "f.*", "persons", "families", "graves")
