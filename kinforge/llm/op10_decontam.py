"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items and documents are sets of 5-word shingles of lower-case words. Items fall into partitions by
their number of shingles, with upper bounds w = 1, 2, 4, ...; for each partition a document is a
row of windows of 2w shingles, one beginning at every w-th place, so that an item that stands in
the document stands whole in a window at most four times its size. That keeps the Jaccard
similarity of item and window above 0.19 for a containment of 0.8 or more, in documents of any
length, and one of ``HASHES`` minimum hashes that item and window share makes a candidate
(missed with a chance below 0.0001). Only windows that hold the shingle behind one of an item's
minima can share a minimum, so only windows that hold a shingle of some item are hashed, and of a
window's minima only those of such a shingle go on. Items of under five words are one shingle of all their words; documents
are searched for runs of as many words. Candidates are verified by the exact containment of the
item's shingles in the document: 0.8 or more. A document's own shingles are first reduced to those
that some item may hold, so no whole document goes through a shuffle.

Defined cases: null and empty texts, as documents or items, match nothing; an item of one to four
words is found wherever these words stand side by side; repeated documents and items are reported
one by one; empty tables give no rows. Columns other than key and text are not read, whatever
their names; ``clean`` judges rows with a null id by their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, no_null, table, words_of

K = 5
HASHES = 48
CONTAINED = 0.8
#: a bitmap has 2 ** BITS bits at least and 2 ** MOST_BITS at most, however many shingles there are
BITS, MOST_BITS = 19, 23
#: most numbers in a side that is broadcast: signature rows of four numbers, or the shingles of all items
SIDE_LIMIT = 2_000_000


def shingle_hashes(words: Column, k: int = K) -> Column:
    """Hashes of the k-word shingles in text order; null if there are fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))


def minimum(shingles: Column, i: Column | int) -> Column:
    """The least (hash, shingle) under hash function i."""
    return F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, F.lit(i) if isinstance(i, int) else i).alias("value"), s.alias("shingle"))))


def windows_of(places: str, w: int) -> Column:
    """The (w, number) of the windows of 2w shingles, one from every w-th place, that hold one of the places."""
    both = F.flatten(F.transform(places, lambda p: F.array(F.floor(p / w) - 1, F.floor(p / w))))
    return F.transform(F.filter(both, lambda k: k >= 0), lambda k: F.struct(F.lit(w).alias("w"), k.alias("k")))


def probes(shingle: Column, bits: int) -> list[Column]:
    """Four bit numbers of a shingle hash."""
    return [F.shiftrightunsigned(shingle, k * 15).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(4)]


class Bitmap:
    """The bits of all shingles as one constant of 64-bit numbers; a full bitmap would only cost time."""

    def __init__(self, shingles: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(BITS, (32 * n).bit_length()))
        bit = shingles.select(F.explode(F.array(*probes(F.col("shingle"), self.bits))).alias("b"))
        rows = bit.groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits")).collect()
        whole = bytearray((1 << self.bits) // 8)
        for r in rows:
            at = (r["k"] - 1) * 4096
            whole[at : at + 4096] = bytes(r["bits"])
        words = [int.from_bytes(whole[i : i + 8], "little", signed=True) for i in range(0, len(whole), 8)]
        self.column = F.from_json(F.lit(str(words)), "array<bigint>")

    def holds(self, shingle: Column) -> Column:
        # one look-up in a loop over the probes: the plan, which the driver keeps and prints, then holds the constant once
        return F.forall(F.array(*probes(shingle, self.bits)), lambda b: F.getbit(F.element_at(self.column, (F.shiftrightunsigned(b, 6) + 1).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1)


def bounded(side: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(side) if numbers <= SIDE_LIMIT else side


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, containment`` for each item that a document holds."""
    words = words_of(no_null(text))
    own = items.select(F.col(item_key).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    whole = F.when(F.size("words") >= K, F.array_distinct(shingle_hashes(F.col("words")))).otherwise(F.array(F.xxhash64("words")))
    own = cut(own.select("item_id", F.least(F.size("words"), F.lit(K)).alias("k"), whole.alias("set")).withColumn("w", F.expr("cast(power(2, ceil(log2(size(set)))) as int)")))
    count = {r["k"]: (r["items"], r["shingles"]) for r in own.groupBy("k").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("set")).alias("shingles")).collect()}
    # the row number keeps the filter above the words, which would else be split again for every shingle
    d = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(key).alias("doc_id")).alias("row"), words.alias("words"))
    none = docs.select(F.col(key).alias("doc_id")).crossJoin(own.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0.0).alias("containment")).where(F.lit(False))
    found = [search(d, own, count) for search, there in ((long_items, K in count), (short_items, any(k < K for k in count))) if there]
    return reduce(DataFrame.unionByName, found) if found else none


def short_items(d: DataFrame, own: DataFrame, count: dict) -> DataFrame:
    """Items of fewer than K words: runs of as many words."""
    sizes = sorted(k for k in count if k < K)
    n = sum(count[k][0] for k in sizes)
    side = own.where(F.col("k") < K).select("item_id", F.col("set")[0].alias("shingle"))
    bitmap = Bitmap(side.select("shingle").distinct(), n)
    runs = F.flatten(F.array(*[F.coalesce(shingle_hashes(F.col("words"), k), F.array().cast("array<bigint>")) for k in sizes]))
    hits = d.select("row", F.explode(F.array_distinct(F.filter(runs, bitmap.holds))).alias("shingle"))
    return hits.join(bounded(side, 2 * n), "shingle").select(F.col("row.doc_id").alias("doc_id"), "item_id", F.lit(1.0).alias("containment"))


def long_items(d: DataFrame, own: DataFrame, count: dict) -> DataFrame:
    n_items, n_shingles = count[K]
    own = own.where(F.col("k") == K)
    signed = own.select("item_id", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), minimum(F.col("set"), i).alias("m")) for i in range(HASHES)])).alias("s"))
    signed = cut(signed.select("item_id", "w", F.col("s.i").alias("i"), F.col("s.m.value").alias("value"), F.col("s.m.shingle").alias("shingle")))
    sizes = sorted(r["w"] for r in own.select("w").distinct().collect())  # at most 31 powers of two
    any_item = Bitmap(own.select(F.explode("set").alias("shingle")).distinct(), n_shingles)
    d = d.select("row", shingle_hashes(F.col("words")).alias("sh"))
    d = d.withColumn("hits", F.filter(F.transform("sh", lambda s, p: F.when(any_item.holds(s), p)), lambda p: p.isNotNull())).where(F.size("hits") > 0)
    d = d.withColumn("held", F.array_distinct(F.transform("hits", lambda p: F.get("sh", p))))
    windows = F.array_distinct(F.flatten(F.array(*[windows_of("hits", w) for w in sizes])))
    part = F.transform(windows, lambda x: F.struct(x["w"].alias("w"), F.slice("sh", (x["k"] * x["w"] + 1).cast("int"), 2 * x["w"]).alias("part")))
    c = d.select("row", "held", F.explode(part).alias("x")).select("row", "held", F.col("x.w").alias("w"), F.col("x.part").alias("part"))
    minima = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), minimum(F.col("part"), i).alias("m")) for i in range(HASHES)]), lambda x: F.array_contains(F.col("held"), x["m"]["shingle"]))
    c = c.select("row", "held", "w", F.explode(minima).alias("m")).select("row", "held", "w", F.col("m.i").alias("i"), F.col("m.m.value").alias("value"))
    found = c.join(bounded(signed.select("item_id", "w", "i", "value"), 4 * HASHES * n_items), ["w", "i", "value"])
    found = found.groupBy("row", "item_id").agg(F.first("held").alias("held"))
    exact = found.join(bounded(own.select("item_id", "set"), n_shingles), "item_id").select("row", "item_id", (F.size(F.array_intersect("set", "held")) / F.size("set")).alias("containment"))
    return exact.where(F.col("containment") >= CONTAINED).select(F.col("row.doc_id").alias("doc_id"), "item_id", "containment")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns; rows with a null id are judged by their text."""
    known, other = docs.where(F.col(key).isNotNull()), docs.where(F.col(key).isNull())
    found = leaks(known, items, key, text=text).select(F.col("doc_id").alias(key)).distinct()
    kept = known.join(found, key, "left_anti").select(*docs.columns)
    by_text = other.select(F.struct(*docs.columns).alias("row"), F.xxhash64(no_null(text)).alias("doc_id"), no_null(text).alias("text"))
    bad = leaks(by_text, items).select("doc_id").distinct()
    return kept.unionByName(by_text.join(bad, "doc_id", "left_anti").select("row.*"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: exact containment of every item in every document: what the search must find
SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bk),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d CROSS JOIN ks),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM bk),
n AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::DOUBLE / q AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, q HAVING count(*)::DOUBLE / q >= 0.8
"""
