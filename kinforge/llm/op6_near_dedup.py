"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with its occurrence. Each of
``SKETCHES`` hash functions selects its two smallest labelled shingles and keeps them in text
order; ``PER_BAND`` such pairs make a band key, and texts that share a key form a bucket.
Similarity is M / (n1 + n2 - M), where M is the length of the longest chain of labelled shingles
common to both in the same order within the band that a similarity of 0.8 allows; the threshold
is 0.8. A pair at 0.8 shares one of the 24 bands with a chance above 0.999.

Texts with equal word sequences form one class representative first. In each bucket every member
is compared with the bucket's head, its shortest member (of equal ones that with the least id), so
that no head holds all that two longer members have in common unless it is near them, and with its
member of the least id, which finds groups that many short heads would hide. What of a member no
shortest head compared with it holds, its rest, is sketched anew, and members whose rests share a key, but which are not linked
yet, form the next buckets; so on until no bucket is left. Members that only share a passage with
a head lose that passage, so they do not meet again, and a bucket of m texts costs at most 2m comparisons
in a round however many groups it holds. A rest loses at least the shingles behind the shared key,
so the rounds end by themselves. The result is each document's class, named by the least doc_id
of its component.

Defined cases: null and empty texts and texts without words stand alone; texts of up to five words
are one shingle and match only equal word sequences; repeated rows share a class; rows with a null
doc_id get no class and stay. Where one doc_id is the least of several texts, each of these texts
is named by a negative number from its hash, so that unrelated texts under one id stay apart; one
row of each class is kept. Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, no_null, stored, table
from .graphs import components

K = 5
SKETCHES = 72
PER_BAND = 3
REST_KEYS = 16
SIMILAR = 0.8
SEED = 31
BLOCK = 1 << 14
KEEP = 250_000
#: bits of the filter over candidate ids; a full one would only cost time
BITMAP_BITS = 1 << 24
#: hot keys and heads are dealt out over this many salts
SALTS = 1024

TOKEN = re.compile(r"[^\W_]+")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    if len(_words) > KEEP:
        _words.clear()
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def labelled(w: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles in text order, each mixed with its number among equal ones."""
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * M1 + w[j : j + n]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(n, np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = np.where(label > 0, mix(h + label * M2), h)
    return h


_rng = np.random.default_rng(SEED)
A = (_rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
B = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def ordered_minima(h: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Order MinHash of two or more labelled shingles: per hash function its two least ones, in text order, as one number."""
    n = len(h)
    every = np.arange(sketches)
    value, place = np.zeros((sketches, 0), np.uint64), np.zeros((sketches, 0), np.int64)
    for start in range(0, n, BLOCK):
        part = h[start : start + BLOCK]
        v = (part ^ (part >> np.uint64(31)))[None, :] * A[:sketches, None] + B[:sketches, None]
        for _ in range(min(2, len(part))):
            i = v.argmin(axis=1)
            value, place = np.column_stack([value, v[every, i]]), np.column_stack([place, i + start])
            v[every, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if value.shape[1] > 2:
            two = np.argsort(value, axis=1, kind="stable")[:, :2]
            value, place = np.take_along_axis(value, two, 1), np.take_along_axis(place, two, 1)
    place = np.sort(place, axis=1)  # the text's order
    return mix(h[place[:, 0]] * M2 + mix(h[place[:, 1]]))


def band_keys(h: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band, none for fewer than two shingles."""
    if len(h) < 2:
        return []
    pair = ordered_minima(h)
    keys = np.zeros(SKETCHES // PER_BAND, np.uint64)
    for j in range(PER_BAND):
        keys = mix(keys * M1 + pair[j::PER_BAND])
    return mix(keys + np.arange(len(keys), dtype=np.uint64) * M1).view(np.int64).tolist()


def rest_keys(h: np.ndarray) -> list[int]:
    """Keys of a rest: one for each hash function; a single shingle is its own key."""
    if len(h) < 2:
        return mix(h * M2).view(np.int64).tolist()
    pair = ordered_minima(h, REST_KEYS)
    return mix(pair + np.arange(1, REST_KEYS + 1, dtype=np.uint64) * M2).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """M / (n1 + n2 - M) by alignment in the band; 0 where the shared shingles alone rule ``least`` out."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least / (1 + least) * (n1 + n2)
    if len(i) < need - 1e-9:
        return 0.0
    band = n1 + n2 - 2 * need  # shingles that may stand on one side only
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        m = len(j)
    else:  # labelled shingles are distinct, so the alignment is a longest increasing run
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    return m / (n1 + n2 - m)


def sequence_numbers(w: np.ndarray, doc: int) -> tuple[int, int]:
    """128 bits of the word sequence; a text without words is its own sequence."""
    if not len(w):
        return doc, 0
    x = xxhash.xxh3_128(w.tobytes()).intdigest()
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def sequence_hash(text: str) -> Column:
    def run(doc: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sequence_numbers(word_hashes(t), d) for d, t in zip(doc, texts)], columns=["h1", "h2"])

    run.__annotations__ = {"doc": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "h1 long, h2 long")(F.col("doc_id"), F.col(text))


SKETCHED = "doc_id long, h1 long, h2 long, keys array<long>, w binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, keys, w): the hash of the word sequence, the band keys, the word hashes cut to 32 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for doc, text in zip(d["doc_id"], d["text"]):
                w = word_hashes(text)
                short = w.astype(np.uint32)
                rows.append((doc, *sequence_numbers(w, doc), band_keys(labelled(short.astype(np.uint64))), short.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "h1", "h2", "keys", "w"])

    return docs.where(F.col("doc_id").isNotNull()).mapInPandas(run, SKETCHED)


def representatives(rows: DataFrame) -> DataFrame:
    """(id, doc, h1, h2, keys, n) for each word sequence; id is its least doc_id, or a negative hash where that id is the least of several, n the size."""
    reps = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"), F.first(F.length("w")).alias("n"))
    reps = cut(reps.withColumn("id", F.col("doc")))
    twice = cut(reps.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"))
    if twice.isEmpty():
        return reps
    own = F.xxhash64("h1", "h2").bitwiseOR(F.lit(-(1 << 63)))
    marked = reps.drop("id").join(twice.withColumn("_t", F.lit(True)), "doc", "left")
    return cut(marked.select(*[c for c in reps.columns if c != "id"], F.when(F.col("_t"), own).otherwise(F.col("doc")).alias("id")))


def salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS))


def head_pairs(members: DataFrame, second: bool) -> DataFrame:
    """(a, b, strikes): the head of each bucket with its members of other labels. ``members`` is (key, id, n, label); a bucket is dealt out by salt.

    With ``second`` members also meet the one of the least id, which strikes nothing from their rests.
    """
    m = members.withColumn("salt", salt("id"))
    first = F.struct("n", "id")
    parts = m.groupBy("key", "salt").agg(F.min(first).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", first).alias("own"), F.min("id").alias("least"))
    heads = parts.groupBy("key").agg(F.min("head")["id"].alias("a"), F.min_by("own", "head").alias("own"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least")).where("lo < hi").select("key", "a", "own", "least")
    dealt = parts.select("key", "salt").join(heads, "key")
    met = m.join(dealt, ["key", "salt"])
    if not second:
        return met.where("label <> own").select("a", F.col("id").alias("b"), F.lit(True).alias("strikes")).distinct()
    both = F.array(F.when(F.col("label") != F.col("own"), F.struct("a", F.lit(True).alias("strikes"))), F.when((F.col("id") != F.col("a")) & (F.col("id") != F.col("least")) & (F.col("least") != F.col("a")), F.struct(F.col("least").alias("a"), F.lit(False).alias("strikes"))))
    return met.select(F.col("id").alias("b"), F.explode(F.array_compact(both)).alias("h")).groupBy("h.a", "b").agg(F.max("h.strikes").alias("strikes"))


def texts_of(ids: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, w) of the ids, from one pass over the sketched rows behind a bitmap of fixed size."""
    wanted = cut(reps.select("id", "doc", "h1", "h2").join(ids, "id", "left_semi"))
    bit = F.pmod(F.xxhash64("h1", "h2"), F.lit(BITMAP_BITS))
    parts = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in parts:
        at = (r["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB, whatever the input

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            bits = d["bit"].to_numpy()
            yield d[((shared.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool)].drop(columns="bit")

    found = rows.select("doc_id", "h1", "h2", "w", bit.alias("bit")).mapInPandas(probe, "doc_id long, h1 long, h2 long, w binary")
    found = found.join(wanted.withColumnRenamed("doc", "doc_id"), ["doc_id", "h1", "h2"]).select("id", "w")
    return stored(found.groupBy("id").agg(F.first("w").alias("w")), "omh-texts")


COMPARED = "id long, linked array<long>, rest binary, keys array<long>, n int"


def compared(pairs: DataFrame, state: DataFrame, texts: DataFrame) -> DataFrame:
    """Each b with the heads that the alignment links it to, and what is left of its rest beside all its heads."""
    p = pairs.withColumn("salt", salt("b"))
    heads = p.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a")  # a head's text goes to at most SALTS places
    against = p.join(heads, ["a", "salt"]).select("b", F.lit(False).alias("own"), "a", "w", F.lit(None).cast("binary").alias("rest"), "strikes")
    own = pairs.where("strikes").select(F.col("b").alias("id")).distinct().join(texts, "id").join(state.select("id", "rest"), "id").select(F.col("id").alias("b"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("a"), "w", "rest", F.lit(False).alias("strikes"))
    both = own.unionByName(against).repartition("b").sortWithinPartitions("b", F.desc("own"), "a")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, left, linked, size = None, None, None, [], 0
        for d in batches:
            out = []
            for b, own_row, a, w, rest, strikes in zip(d["b"], d["own"], d["a"], d["w"], d["rest"], d["strikes"]):
                x = labelled(np.frombuffer(w, np.uint32).astype(np.uint64))
                if own_row:
                    if now is not None:
                        out.append((now, linked, left.astype(np.uint32).tobytes(), rest_keys(h[left]), size))
                    now, h, linked, size = b, x, [], len(w)
                    left = np.arange(len(x)) if rest is None else np.frombuffer(rest, np.uint32).astype(np.int64)
                else:
                    if similarity(h, x) >= SIMILAR:
                        linked.append(a)
                    if strikes:
                        left = left[~np.isin(h[left], x)]
            if out:
                yield pd.DataFrame(out, columns=["id", "linked", "rest", "keys", "n"])
        if now is not None:
            yield pd.DataFrame([(now, linked, left.astype(np.uint32).tobytes(), rest_keys(h[left]), size)], columns=["id", "linked", "rest", "keys", "n"])

    return both.mapInPandas(align, COMPARED)


def near_labels(reps: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(id, label) of the representatives that have a link; None if no two share a key."""
    state = reps.select("id", F.lit(None).cast("binary").alias("rest"), "keys", "n")
    texts = labels = None
    while True:
        members = state.select("id", "n", F.explode("keys").alias("key"))
        members = members.withColumn("label", F.col("id")) if labels is None else members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        first = texts is None
        pairs = cut(head_pairs(members, first))
        if pairs.isEmpty():
            return labels
        if first:
            texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), reps, rows)
        new = cut(compared(pairs, state, texts))
        links = new.select(F.explode("linked").alias("a"), F.col("id").alias("b"))
        if not links.isEmpty():
            labels = cut(components(links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))))
        rests = new.where(F.size("keys") > 0).select("id", "rest", "keys", "n")
        # who was only a head in the first round has met every member of its buckets; later, those linked to their head already wait
        state = cut(rests if first else rests.unionByName(state.join(new, "id", "left_anti")))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, kept, h1, h2`` for every row with an id; class_id is the least doc_id of the class."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), no_null(text).alias("text"))
    with batches_of(docs.sparkSession):
        rows = stored(sketches(d), "omh")
        reps = representatives(rows)
        labels = near_labels(reps, rows)
    names = reps.select("h1", "h2", "doc", "id")
    names = names.withColumn("label", F.col("id")) if labels is None else names.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = names.select("h1", "h2", F.col("label").alias("class_id"), F.when(F.col("id") == F.col("label"), F.col("doc")).alias("_first"))
    return rows.select("doc_id", "h1", "h2").join(names, ["h1", "h2"]).select("doc_id", "class_id", (F.col("doc_id") == F.coalesce("_first", F.col("doc_id") - 1)).alias("kept"), "h1", "h2")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates of an earlier doc_id; rows with a null id stay."""
    classes = near_classes(docs, key, text)
    kept = cut(classes.where("kept").groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"), no_null(text).alias("text"))
    once = kept.select("doc_id").distinct()
    out = here.join(once, "doc_id", "left_semi")
    several = cut(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not several.isEmpty():  # ids on several rows: one row of each kept text stays
        doubtful = out.join(several, "doc_id", "left_semi").withColumn("h", sequence_hash("text"))
        doubtful = doubtful.join(kept.select("doc_id", F.struct("h1", "h2").alias("h")), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
        out = out.join(several, "doc_id", "left_anti").select("row").unionByName(doubtful.select("row"))
    return out.select("row.*").unionByName(docs.where(F.col(key).isNull()))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
