"""Line dedup by a deletion-neighbourhood join.

A line is the words between white space, lower-case. Two lines are near if one word changed,
inserted or deleted makes them equal and they have at least ``MIN_WORDS`` words; shorter lines
must be equal. A line goes if an equal or near line stands earlier, by (doc_id, line number).

Every line's variants with one word deleted are hashed with the place of the deletion; the line
itself is its variant without a place. Lines that share a variant at the same place differ in that
word; a line that is another's variant lacks one. So the earliest line of each variant and place,
and of each variant, is a partner for all later ones, and a group is reduced to minima rather than
joined pair by pair. Partners are verified by word edit distance. Only lines that share half of
their words with another line can have a partner: one change leaves the first or the second half
untouched, so lines whose hashed halves occur once emit no variants. Texts are read and split once,
in Arrow batches; a line's variants take time in proportion to its length, by sums of powers.

Defined cases: null texts and empty lines are left as they are; rows that share a doc_id are one
document; repeated lines keep their first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, no_null, small_batches, stored, table

MIN_WORDS = 8
#: lines, or variants, in an Arrow batch that goes out
ROWS_OUT = 20_000
KEEP = 250_000
BITMAP_BITS = 1 << 23
BASE = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def half_keys(words: list[str]) -> list[int]:
    """Hashes of the halves that a line shares with one that has a word changed, added or missing."""
    n, out = len(words), []
    for m in (n, n - 1):
        front, back = words[: m // 2], words[n - (m - m // 2) :]
        out += [signed(xxhash.xxh64_intdigest(f"{m} {side} " + " ".join(part))) for side, part in enumerate((front, back))]
    return out


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, h1, h2`` of every line that has words; long ones also have ``halves`` and ``line``."""
    names = ["doc_id", "line_no", "h1", "h2", "halves", "line"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []

            def packed() -> pa.RecordBatch:
                columns = zip(*rows) if rows else [[]] * len(types)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

            for i, body in enumerate(b.column(1)):
                for no, line in enumerate(body.as_py().split("\n")):
                    words = line.lower().split()
                    if words:
                        whole = " ".join(words)
                        x = xxhash.xxh3_128_intdigest(whole)
                        long = len(words) >= MIN_WORDS
                        at.append(i)
                        rows.append((no, signed(x >> 64), signed(x & (1 << 64) - 1), half_keys(words) if long else None, whole if long else None))
                if len(rows) >= ROWS_OUT:
                    yield packed()
                    at, rows = [], []
            yield packed()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), no_null(text).alias("text")).mapInArrow(run, f"doc_id {kind}, line_no int, h1 long, h2 long, halves array<long>, line string")


def variant_hashes(w: np.ndarray) -> np.ndarray:
    """Hashes of the word hashes without each of them in turn, behind that of all of them."""
    n = len(w)
    power = np.full(n + 1, np.uint64(BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    whole = w * power[n - 1 :: -1][:n]
    shorter = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w[:-1] * power[: n - 1][::-1], dtype=np.uint64)])
    behind = np.concatenate([np.cumsum(whole[::-1], dtype=np.uint64)[::-1][1:], np.zeros(1, np.uint64)])
    x = np.concatenate([whole.sum(dtype=np.uint64, keepdims=True), shorter + behind])
    x[0] += np.uint64(n) * power[1]
    x[1:] += np.uint64(n - 1) * power[1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def variants(lines: DataFrame) -> DataFrame:
    """``id, p, v``: place 0 is the line itself, place p the line without its word p."""
    known: dict[str, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places, hashes, n = [], [], [], 0

            def packed() -> pa.RecordBatch:
                columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((ids, np.int64), (places, np.int32), (hashes, np.int64))]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "p", "v"])

            for i, line in zip(b.column(0).to_pylist(), b.column(1)):
                if len(known) > KEEP:
                    known.clear()
                words = line.as_py().split(" ")
                for x in words:
                    if x not in known:
                        known[x] = xxhash.xxh64_intdigest(x)
                v = variant_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                ids.append(np.full(len(v), i, np.int64))
                places.append(np.arange(len(v), dtype=np.int32))
                hashes.append(v.view(np.int64))
                n += len(v)
                if n >= ROWS_OUT:
                    yield packed()
                    ids, places, hashes, n = [], [], [], 0
            yield packed()

    return lines.select("id", "line").mapInArrow(run, "id long, p int, v long")


def within_one(a: list, b: list) -> bool:
    """Whether the word edit distance is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lines_among(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines (h1, ...) that may be among the ids, by a bitmap of fixed size: few texts are shuffled then."""
    bit = F.pmod("id", F.lit(BITMAP_BITS)) + 1
    found = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in found:
        at = (r["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column(0).to_numpy() & (BITMAP_BITS - 1)
            yield b.filter(pa.array(((bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)))

    d = lines.where("line is not null").select(F.col("h1").alias("id"), F.struct("doc_id", "line_no").alias("rank"), "line")
    return d.mapInArrow(run, d.schema)


def near_removed(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """``id`` of the distinct lines (id, halves) that have a verified near line of lower rank."""
    halves = distinct.where("halves is not null").select("id", F.explode("halves").alias("k"))
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    some = cut(halves.join(shared, "k", "left_semi").select("id").distinct())
    firsts = lines_among(lines, some).groupBy("id").agg(F.min("rank").alias("rank"), F.first("line").alias("line"))
    near_lines = stored(firsts.join(some, "id", "left_semi"), "lines")
    # nearly all variants occur once; only shared ones take their line's rank along
    every = stored(variants(near_lines), "variants")
    twice = every.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    v = stored(every.join(twice, "v", "left_semi").join(near_lines.select("id", "rank"), "id"), "shared")
    best = v.groupBy("v", "p").agg(F.min(F.struct("rank", "id")).alias("m"), F.count(F.lit(1)).alias("c"))
    group = best.groupBy("v").agg(F.min(F.when(F.col("p") == 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("p") > 0, F.col("m"))).alias("part"), F.sum("c").alias("c")).where("c > 1 and whole is not null and part is not null")
    near = v.join(group, "v").where((F.col("p") == 0) & (F.col("part.rank") < F.col("rank")) | (F.col("p") > 0) & (F.col("whole.rank") < F.col("rank")))
    near = near.select("id", F.when(F.col("p") == 0, F.col("part.id")).otherwise(F.col("whole.id")).alias("other"))
    same = v.where("p > 0").join(best.where("c > 1 and p > 0").select("v", "p", "m"), ["v", "p"]).where(F.col("m.rank") < F.col("rank")).select("id", F.col("m.id").alias("other"))
    pairs = near.unionByName(same).where("id <> other").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"id": [i for i, a, b in zip(d["id"], d["line"], d["others"]) if within_one(a.split(" "), b.split(" "))]}, dtype="int64")

    words = near_lines.select("id", "line")
    both = pairs.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("line").alias("others")), "other")
    return both.select("id", "line", "others").mapInPandas(check, "id long").distinct()


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no`` of the lines that go."""
    small_batches(docs.sparkSession)
    lines = stored(lines_of(docs, key, text), "all-lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("rank"), F.first("halves").alias("halves"))
    distinct = stored(firsts.select("h1", "h2", F.col("h1").alias("id"), "rank", "halves"), "distinct")
    near = near_removed(distinct, lines).withColumn("near", F.lit(True))
    fate = distinct.select("h1", "h2", "id", "rank").join(near, "id", "left").select("h1", "h2", "rank", F.coalesce("near", F.lit(False)).alias("near"))
    return lines.select("doc_id", "line_no", "h1", "h2").join(fate, ["h1", "h2"]).where(F.col("near") | ~F.col("rank").eqNullSafe(F.struct("doc_id", "line_no"))).select("doc_id", "line_no")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that go; other columns are as they were."""
    gone = removals(docs, key, text).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_key")
    d = docs.join(gone, docs[key].eqNullSafe(F.col("_key")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return d.select(*[(F.when(F.col("_gone").isNull(), docs[c]).otherwise(kept).alias(c) if c == text else docs[c]) for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removals(docs).groupBy("doc_id").agg(F.countDistinct("line_no").alias("n_removed"), F.array_sort(F.collect_set("line_no")).alias("removed"))
    d = docs.select("doc_id", F.size(F.split(no_null("text"), "\n")).alias("n_lines"))
    d = d.join(gone.withColumnRenamed("doc_id", "_key"), F.col("doc_id").eqNullSafe(F.col("_key")), "left")
    return d.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
