"""Named queries over the driver's tables: each applies one operator to an input derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.operators import expand, export, graph, increments, merge, privacy, relational, tree
from kinforge.operators.checkpoints import cut, stored
from kinforge.plans import chronicle, imports, listings, rendered
from kinforge.plans.derived import AS_OF, clan_lines, kinship, life_lines, order_dates, order_lines, page_links, people, spouses, table, trees, wedding_lines
from kinforge.sources import ged

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _c(name: str):
    return F.col(name)


# -- persons, surnames
@query
def surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.surnames(people(spark, sf_dir)).orderBy("sort_key")


@query
def surname_place(spark, sf_dir):
    return relational.surname_places(people(spark, sf_dir))


@query
def person_lookup(spark, sf_dir):
    return relational.find_persons(people(spark, sf_dir), "customer build", year=1873).select("ptr", "surname", "birth_date")


@query
def person_pointer(spark, sf_dir):
    return relational.find_persons(people(spark, sf_dir), pointer="i42").select("ptr", "surname", "place")


@query
def family_rows(spark, sf_dir):
    n = cut(ged.lines_to_nodes(wedding_lines(spark, sf_dir)))
    return relational.families(n, relational.persons(n)).select("ptr", "husband", "wife", "marriage_date")


@query
def duplicate_persons(spark, sf_dir):
    return relational.ordered(merge.duplicate_persons(people(spark, sf_dir)), "ptr").select("ptr", "master")


# -- dates
@query
def date_norm(spark, sf_dir):
    return dates.normalized(order_dates(spark, sf_dir), "raw").select("o_orderkey", "raw", "value", F.isnotnull("warning").alias("warned"))


@query
def date_sort_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.from_iso(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("canonical"))
    k = dates.sort_key(_c("canonical"))
    return o.orderBy(k["y"], k["m"], k["d"], "o_orderkey").limit(50)


@query
def year_partial(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy").substr(1, 3), F.lit("_")).alias("raw"))
    return o.select("o_orderkey", dates.birth_year(_c("raw")).cast("long").alias("birth_year"))


@query
def year_extractors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("no "), (_c("event_id") % 4000).cast("string")).alias("t"))
    return e.select("event_id", dates.year_strict(_c("t")).alias("strict"), dates.year_query(_c("t")).alias("query"), dates.year_any(_c("t")).alias("loose"), dates.year_four(_c("t")).alias("four"))


@query
def date_compact(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(_c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(_c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMM'00'")).otherwise(F.date_format("o_orderdate", "yyyy'0000'"))
    return o.select("o_orderkey", dates.from_compact(raw).alias("value"))


@query
def date_slovenian(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(_c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d. M. yyyy")).otherwise(F.concat(F.lit("?. "), F.date_format("o_orderdate", "M. yyyy")))
    return o.select("o_orderkey", dates.from_slovenian(raw).alias("value"))


# -- names
@query
def name_placeholder(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    given = F.element_at(F.array(*[F.lit(x) for x in ("???", "Unknown", "_XY_", "(neznan)", "Ana")]), (_c("c_custkey") % 5 + 1).cast("int"))
    surname = F.when(_c("c_custkey") % 3 == 0, "-xxx-").when(_c("c_custkey") % 3 == 1, "").otherwise(_c("c_mktsegment"))
    return c.select("c_custkey", text.clean_name_placeholder(F.concat(given, F.lit("  /"), surname, F.lit(" /"))).alias("name"))


@query
def name_capitals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"), (_c("p_partkey") % 6).alias("k"))
    forms = [F.upper(F.concat_ws("-", "a", "b")), F.concat_ws(" ", "a", "b"), F.upper(F.concat(_c("a"), F.lit(" von der "), _c("b"))), F.concat(F.lit("nn  /de "), F.upper("b"), F.lit("/")), F.concat(F.upper("a"), F.lit(" ("), _c("b"), F.lit(") /Mc"), F.initcap("b"), F.lit("/")), F.concat(F.lit("V. "), F.upper("a"), F.lit(" V. /NN/"))]
    raw = F.element_at(F.array(*forms), (_c("k") + 1).cast("int"))
    return p.select("p_partkey", text.capitalize_name(raw).alias("title"), text.lower_if_shouted(raw).alias("lowered"))


@query
def name_initials(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    full = F.concat(F.element_at(w, 1), F.lit(" /"), F.element_at(w, 2), F.lit("/"))
    return p.select("p_partkey", text.initials(_c("p_name")).alias("initials"), text.shorten_name(full).alias("short"), text.shorten_given(full).alias("given_short"))


@query
def name_split(spark, sf_dir):
    p = text.name_parts(F.concat(F.lit("  "), _c("c_name"), F.lit(" /"), _c("c_mktsegment"), F.lit("/ jr. ")))
    return table(spark, sf_dir, "customer").select("c_custkey", p["given"].alias("given"), p["surname"].alias("surname"))


# -- places and ids
def _places(spark, sf_dir):
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    d = c.join(n, _c("c_nationkey") == _c("n_nationkey")).join(r, _c("n_regionkey") == _c("r_regionkey"))
    return d.select("c_custkey", F.concat_ws(", ", "c_name", "n_name", F.lower("n_name"), "r_name").alias("place"), "c_name", "n_name", "r_name")


@query
def place_duplicates(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", text.place_duplicates(_c("place")).alias("place"))


@query
def place_ends(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", text.place_ends(_c("place")).alias("place"))


@query
def place_country(spark, sf_dir):
    raw = F.when(_c("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", SLOVENIJA"))).otherwise(F.concat("c_name", F.lit(", Slovenia, Europe")))
    return _places(spark, sf_dir).select("c_custkey", text.place_without_country(raw).alias("place"))


@query
def place_placeholder(spark, sf_dir):
    raw = F.when(_c("c_custkey") % 3 == 0, "_, (?)").otherwise(_c("n_name"))
    return _places(spark, sf_dir).select("c_custkey", text.place_placeholder(raw).alias("place"))


@query
def make_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.stable_id(_c("c_name"), _c("c_mktsegment")).alias("id"))


# -- trees
def _nodes(spark, sf_dir):
    return ged.lines_to_nodes(order_lines(spark, sf_dir))


@query
def tree_parents(spark, sf_dir):
    n = tree.with_parents(_nodes(spark, sf_dir))
    return n.where("level > 0").select(_c("ord").cast("long").alias("no"), "level", "tag", "value", "parent_tag", "parent_value", "rec_tag")


@query
def strip_subtree(spark, sf_dir):
    """Items with all their attributes go."""
    return tree.strip(_nodes(spark, sf_dir), tree.Strip(("EVEN",), parent="INDI")).select(_c("ord").cast("long").alias("no"), "tag", "value")


@query
def strip_level(spark, sf_dir):
    return tree.strip(_nodes(spark, sf_dir), tree.STRIPS["change_date"]).groupBy("tag", "level").agg(F.count(F.lit(1)).alias("n"))


@query
def tag_rename(spark, sf_dir):
    n = tree.rename(_nodes(spark, sf_dir), "EVEN", "FACT", "Shipment")
    return n.groupBy("level", "tag", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def address_to_place(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    d = c.join(n, _c("c_nationkey") == _c("n_nationkey"))
    b = _c("c_custkey") * 10
    rows = F.array(F.struct(b.alias("no"), F.concat(F.lit("0 @I"), _c("c_custkey").cast("string"), F.lit("@ INDI")).alias("line")), F.struct((b + 1).alias("no"), F.lit("1 BIRT").alias("line")), F.struct((b + 2).alias("no"), F.concat(F.lit("2 ADDR "), "n_name", F.lit(" "), "c_mktsegment").alias("line")), F.struct((b + 3).alias("no"), F.when(_c("c_custkey") % 2 == 0, F.concat(F.lit("2 PLAC "), "n_name", F.lit(", Europe"))).otherwise("2 NOTE x").alias("line")))
    lines = d.select(F.concat(F.lit("f"), F.floor(_c("c_custkey") / 100).cast("string")).alias("file"), F.explode(rows).alias("r")).select("file", "r.no", "r.line")
    out = tree.address_to_place(ged.lines_to_nodes(lines))
    return out.where("tag in ('PLAC', 'ADDR')").select(_c("rec_tag"), "level", "tag", "value")


@query
def tree_text(spark, sf_dir):
    """Every file written back: its number of lines and its md5."""
    t = ged.serialize(_nodes(spark, sf_dir))
    return t.select("file", F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"), F.md5(_c("text").cast("binary")).alias("digest"))


@query
def cleaner_changes(spark, sf_dir):
    before = _nodes(spark, sf_dir)
    return tree.changes(before, tree.rename(tree.strip(before, tree.STRIPS["change_date"]), "TYPE", "KIND"))


@query
def stat_counts(spark, sf_dir):
    return relational.stats(_nodes(spark, sf_dir)).groupBy("label").agg(F.sum("n").alias("n"))


# -- kinship
def _seed(spark, key):
    return spark.range(1).select(F.lit("f").alias("file"), F.lit(key).cast("long").alias("id"))


@query
def ancestors(spark, sf_dir):
    return graph.ancestors(kinship(spark, sf_dir), _seed(spark, 97)).select("id", "depth")


@query
def descendants(spark, sf_dir):
    return graph.descendants(kinship(spark, sf_dir), _seed(spark, 5)).select("id", "depth")


@query
def bloodline(spark, sf_dir):
    return graph.bloodline(trees(spark, sf_dir), _seed(spark, 111)).select("id")


@query
def siblings(spark, sf_dir):
    return graph.siblings(kinship(spark, sf_dir), _seed(spark, 25)).select("id")


@query
def partners(spark, sf_dir):
    return graph.partners(spouses(spark, sf_dir), _seed(spark, 7)).select("id")


@query
def filter_cleanup(spark, sf_dir):
    """The links left among the descendants of one person and their families."""
    n = stored(ged.lines_to_read(clan_lines(spark, sf_dir)))
    seed = spark.range(1).select(F.lit("f").alias("file"), F.lit("@I3@").alias("id"))
    kept = graph.keep(n, graph.descendants(graph.parents(graph.edges(n)), seed))
    owners = kept.where("level = 0").select("file", "rec", _c("pointer").alias("owner"))
    return kept.where("tag in ('FAMC', 'FAMS', 'HUSB', 'WIFE', 'CHIL')").join(owners, ["file", "rec"]).select("owner", "tag", "value")


@query
def filter_expand(spark, sf_dir):
    """Ancestors of two persons with siblings and partners, their descendants forbidden."""
    n = stored(ged.lines_to_read(clan_lines(spark, sf_dir)))
    roots = spark.createDataFrame([("f", "@I97@"), ("f", "@I64@")], "file string, id string")
    people, _, _ = expand.filtered(n, roots, siblings=True, partners=True)
    return people.select("id")


@query
def filter_related(spark, sf_dir):
    """How many persons and families the descendants of one person with their relatives are, one round of them."""
    n = stored(ged.lines_to_read(clan_lines(spark, sf_dir)))
    roots = spark.createDataFrame([("f", "@I7@")], "file string, id string")
    _, _, counts = expand.filtered(n, roots, ancestors=False, descendants=True, with_related=True, related_depth=1)
    return counts.select("id", "persons")


@query
def surname_origins(spark, sf_dir):
    """Places by the nearest ancestor of the same surname; only persons of every seventh key have one of their own."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), _c("c_nationkey") == _c("n_nationkey"))
    own = c.select(F.lit("f").alias("file"), _c("c_custkey").alias("id"), F.when(_c("c_mktsegment") < "C", "A").otherwise("B").alias("surname"), F.when(_c("c_custkey") % 7 == 0, _c("n_name")).alias("place"))
    return expand.surname_origin(own, kinship(spark, sf_dir)).select("id", "place")


# -- privacy
def _lives(spark, sf_dir):
    return privacy.lives(ged.lines_to_nodes(life_lines(spark, sf_dir)))


@query
def private_born(spark, sf_dir):
    return _lives(spark, sf_dir).where(privacy.born_within(AS_OF)).select("ptr")


@query
def private_died(spark, sf_dir):
    return _lives(spark, sf_dir).where(privacy.died_within(AS_OF)).select("ptr")


@query
def strip_living(spark, sf_dir):
    return _lives(spark, sf_dir).where(privacy.may_live(AS_OF)).select("ptr")


@query
def private_families(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    b = _c("c_custkey") * 4
    person = F.array(F.struct(b.alias("no"), F.concat(F.lit("0 @I"), _c("c_custkey").cast("string"), F.lit("@ INDI")).alias("line")), F.struct((b + 1).alias("no"), F.concat(F.lit("1 NAME "), F.when(_c("c_custkey") % 3 == 0, "<private>").otherwise("Ana /N/")).alias("line")))
    f = F.lit(10_000_000_000) + _c("c_custkey") * 10
    family = F.array(F.struct(f.alias("no"), F.concat(F.lit("0 @F"), _c("c_custkey").cast("string"), F.lit("@ FAM")).alias("line")), F.struct((f + 1).alias("no"), F.concat(F.lit("1 HUSB @I"), _c("c_custkey").cast("string"), F.lit("@")).alias("line")), F.struct((f + 2).alias("no"), F.concat(F.lit("1 WIFE @I"), (F.floor(_c("c_custkey") / 2)).cast("string"), F.lit("@")).alias("line")), F.struct((f + 3).alias("no"), F.lit("1 MARR Y").alias("line")))
    lines = c.select(F.lit("f").alias("file"), F.explode(F.concat(person, family)).alias("r")).select("file", "r.no", "r.line")
    out = privacy.private_families(ged.lines_to_nodes(lines))
    heads = out.where("level = 0 and tag = 'FAM'").select("rec", _c("pointer").alias("family"))
    return heads.join(out.where("tag = 'MARR'").select("rec", _c("value").alias("marriage")), "rec").select("family", "marriage")


# -- links
@query
def link_domains(spark, sf_dir):
    return relational.top_links(page_links(spark, sf_dir), text.domain(_c("url")), "page_id", 10)


@query
def link_paths(spark, sf_dir):
    return relational.top_links(page_links(spark, sf_dir), text.domain_path(_c("url"), 1), "url", 20)


@query
def url_search(spark, sf_dir):
    lines = page_links(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    at = _c("page_id") * 100_000
    row = lambda no, line: F.struct(no.cast("long").alias("no"), line.alias("line"))
    rows = F.concat(F.array(row(at, F.concat(F.lit("0 @P"), _c("page_id").cast("string"), F.lit("@ INDI")))), F.transform("urls", lambda u, i: row(at + i + 1, F.concat(F.lit("1 NOTE see "), u))))
    n = ged.lines_to_nodes(lines.select(F.lit("f").alias("file"), F.explode(rows).alias("r")).select("file", "r.no", "r.line"))
    heads = n.where("level = 0").select("file", "rec", "pointer")
    return relational.url_search(n, "/de").join(heads, ["file", "rec"]).select("pointer", "url")


@query
def duplicate_urls(spark, sf_dir):
    return relational.duplicate_urls(page_links(spark, sf_dir).withColumnRenamed("page_id", "owner"))


@query
def link_audit(spark, sf_dir):
    p = page_links(spark, sf_dir).withColumn("label", F.concat(F.lit("p"), (_c("page_id") % 3).cast("string")))
    return relational.link_audit(p.select("url", "label"), table(spark, sf_dir, "pages").select("url").unionByName(p.where("label = 'p0'").select("url")))


# -- merge, dedupe, totals, increments
@query
def merge_pointers(spark, sf_dir):
    def lines(name, key, value):
        at = _c(key) * 10
        rows = F.array(F.struct(at.cast("long").alias("no"), F.concat(F.lit("0 @N"), _c(key).cast("string"), F.lit("@ INDI")).alias("line")), F.struct((at + 1).cast("long").alias("no"), F.concat(F.lit("1 NAME "), value).alias("line")))
        return table(spark, sf_dir, name).select(F.lit(name).alias("file"), F.explode(rows).alias("r")).select("file", "r.no", "r.line")

    both = lines("nation", "n_nationkey", _c("n_name")).unionByName(lines("region", "r_regionkey", F.concat(F.lit("@N"), _c("r_regionkey").cast("string"), F.lit("@"))))
    return merge.merge(ged.lines_to_nodes(both), ["nation", "region"]).select("level", "tag", F.coalesce("pointer", F.lit("")).alias("pointer"), "value")


@query
def dedupe_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.floor(_c("c_acctbal") / 100).cast("long").alias("band"))
    return merge.exact_groups(c, ["c_mktsegment", "c_nationkey", "band"], "c_custkey").select("c_custkey", "master", "n")


@query
def metadata_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(_c("n_nationkey").cast("long").alias("contributor"), _c("n_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("contributor"), _c("s_name").alias("name"))
    return merge.upsert(old, new, "contributor")


@query
def incremental_skip(spark, sf_dir):
    """Users with events behind their last finished run."""
    e = table(spark, sf_dir, "events")
    newest = e.groupBy(_c("user_id").alias("file")).agg(F.max("ts").alias("modified"))
    done = e.where("event_id % 2 = 0").select(_c("user_id").alias("file"), _c("ts").alias("finished"))
    return increments.stale(newest, done).select(_c("file").alias("user_id"))


@query
def grave_stats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return l.join(p, _c("l_partkey") == _c("p_partkey")).groupBy("p_type").agg(F.count(F.lit(1)).alias("persons"), F.countDistinct("l_orderkey").alias("graves"), F.min(F.struct("p_partkey", "p_type"))["p_partkey"].alias("first_part"))


@query
def rollup_total(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(_c("o_orderpriority").alias("file"), _c("o_orderstatus").alias("processor"), F.lit(1).cast("long").alias("n"))
    return relational.totals(d)


QUERIES.update(imports.QUERIES | rendered.QUERIES | chronicle.QUERIES | listings.QUERIES)
