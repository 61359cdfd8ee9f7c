"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are in shards of near vectors (``integer_vectors``). Each shard becomes a tree: halves at the
median of the component of widest spread, with tight boxes and the least id below each node. A query
walks a tree best first: the node whose box allows the largest inner product comes next, and the walk ends
when that bound is under the query's k-th score (or equals it, and no id below is smaller than the k-th).
First each query walks the shard it lies in; the k-th score found there is carried to the other shards,
whose boxes drop out if their bound does not reach it, and into the walks of those that stay. Queries meet
boxes and trees in groups of bounded size. Scores are integers and exact.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, nor do rows
with a null id; vectors of different lengths are never compared, empty vectors have score 0 with each
other; rows with repeated ids are rows of their own, each a query and a candidate of the others; a score
beyond the range of long is held at its end; with fewer candidates than asked for, all are returned; an
empty table gives no rows; columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, stored, table
from .integer_vectors import LONG, SCALE, integer_rows, largest, matrix, pack, products, sharded, unpack

TOP = 5
SHARD = 8192
LEAF = 256
#: queries that walk a tree together, that meet one copy of a tree, and boxes that meet a query together
TOGETHER, VISITS, BOXES = 1024, 32_768, 1024
#: a k-th score and id that every candidate beats
LOWEST, HIGHEST = LONG
FOUND = "array<struct<query:long,query_id:long,vec_id:long,score:long>>"
FOREST = f"shard string, size int, uids array<long>, ids array<long>, vecs binary, starts array<int>, stops array<int>, lefts array<int>, low binary, high binary, least array<long>, asked array<long>, found {FOUND}"


class Tree:
    """Median splits of the rows of a shard; children of node n are ``left[n]`` and the next, -1 at leaves."""

    def __init__(self, uids, ids, x, start, stop, left, low, high, least):
        self.uids, self.ids, self.x, self.start, self.stop, self.left, self.low, self.high, self.least = uids, ids, x, start, stop, left, low, high, least

    @classmethod
    def build(cls, uids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Tree:
        order, spans, left = np.arange(len(ids)), [(0, len(ids))], []
        for start, stop in spans:  # grows while it is walked
            left.append(-1)
            if stop - start > LEAF:
                part = order[start:stop]
                widest = int((x[part].max(axis=0).astype(np.float64) - x[part].min(axis=0)).argmax()) if x.shape[1] else 0
                half = (stop - start) // 2
                if x.shape[1]:
                    order[start:stop] = part[np.argpartition(x[part, widest], half)]
                left[-1] = len(spans)
                spans += [(start, start + half), (start + half, stop)]
        uids, ids, x = uids[order], ids[order], x[order]
        low = np.stack([x[a:b].min(axis=0) for a, b in spans])
        high = np.stack([x[a:b].max(axis=0) for a, b in spans])
        start, stop = np.array(spans, np.int32).T
        return cls(uids, ids, x, start, stop, np.array(left, np.int32), low, high, np.array([ids[a:b].min() for a, b in spans]))

    @classmethod
    def read(cls, row) -> Tree:
        size, n = row["size"], len(row["starts"])
        x = unpack(row["vecs"], size) if size else np.zeros((len(row["ids"]), 0), np.int64)
        low, high = (unpack(row[c], size) if size else np.zeros((n, 0), np.int64) for c in ("low", "high"))
        return cls(*(np.asarray(row[c]) for c in ("uids", "ids")), x, *(np.asarray(row[c]) for c in ("starts", "stops", "lefts")), low, high, np.asarray(row["least"]))

    def row(self) -> dict:
        return {"uids": self.uids, "ids": self.ids, "vecs": pack(self.x), "starts": self.start, "stops": self.stop, "lefts": self.left, "low": pack(self.low), "high": pack(self.high), "least": self.least}


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner product that each query can have with a point in each box; never too small."""
    q, low, high = (a.astype(np.float64) for a in (q, low, high))
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if np.abs(q).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(1, q.shape[1]) >= 2**53:
        out += 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return out


def walk(tree: Tree, uids: np.ndarray, q: np.ndarray, worst: np.ndarray, tie: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the best (score, id) of the shard, k at most, of those that beat (worst, tie).

    Where no k-th score is known yet these are (LOWEST, HIGHEST). Queries advance together, each by its own best node.
    """
    worst, tie = worst.copy(), tie.copy()
    best: list[list[tuple[int, int]]] = [[] for _ in uids]
    exact = largest(q) * largest(tree.x) * max(1, q.shape[1]) < 2**53
    least = tree.least.tolist()
    heaps = [[(-b, 0)] for b in bounds(q, tree.low[:1], tree.high[:1])[:, 0].tolist()]
    active = list(range(len(uids)))
    while active:
        met: dict[int, list[int]] = defaultdict(list)
        for i in active:
            if heaps[i]:
                b, node = heapq.heappop(heaps[i])
                if -b > worst[i] or (-b == worst[i] and (least[node] <= tie[i] or not exact)):
                    met[node].append(i)
                elif -b == worst[i]:
                    met[-1].append(i)  # only ids that are too large there: the next node of the same bound may do
        for node, rows in met.items():
            if node < 0:
                continue
            left = tree.left[node]
            if left >= 0:
                for child, b in zip((left, left + 1), bounds(q[rows], tree.low[left : left + 2], tree.high[left : left + 2]).T):
                    for i, bound in zip(rows, b.tolist()):
                        if bound >= worst[i]:
                            heapq.heappush(heaps[i], (-bound, int(child)))
                continue
            span = slice(tree.start[node], tree.stop[node])
            scores = products(q[rows], tree.x[span])
            ids, own = tree.ids[span], tree.uids[span]
            good = (scores >= worst[rows][:, None]) & (own[None, :] != uids[rows][:, None])
            for r in np.flatnonzero(good.any(axis=1)).tolist():
                i, at = rows[r], np.flatnonzero(good[r])
                s = scores[r, at]
                if len(at) > k:
                    at = at[np.lexsort((ids[at], ~s))[:k]]  # ~s falls as s rises, and has no overflow
                    s = scores[r, at]
                new = [(-a, b) for a, b in zip(s.tolist(), ids[at].tolist()) if a > worst[i] or b <= tie[i]]
                best[i] = heapq.nsmallest(k, best[i] + new)
                if len(best[i]) == k and (-best[i][-1][0] > worst[i] or best[i][-1][1] < tie[i]):
                    worst[i], tie[i] = -best[i][-1][0], best[i][-1][1]
        active = [i for rows in met.values() for i in rows]
    return [[(-s, v) for s, v in b] for b in best]


def walk_all(tree: Tree, queries: pd.DataFrame, q: np.ndarray, k: int) -> pd.DataFrame:
    """(query, query_id, vec_id, score) of queries with columns uid, id, worst and tie, some of them at a time."""
    out = []
    uids, ids = queries["uid"].to_numpy(), queries["id"].to_numpy()
    worst, tie = queries["worst"].to_numpy(np.int64), queries["tie"].to_numpy(np.int64)
    for lo in range(0, len(queries), TOGETHER):
        s = slice(lo, lo + TOGETHER)
        for uid, own, found in zip(uids[s].tolist(), ids[s].tolist(), walk(tree, uids[s], q[s], worst[s], tie[s], k)):
            out += [(uid, own, v, score) for score, v in found]
    return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype(np.int64)


def plant(rows: DataFrame, k: int) -> DataFrame:
    """One row a shard: its tree, and what the shard's own queries find in it."""

    def build(d: pd.DataFrame) -> pd.DataFrame:
        size = int(d["size"].iloc[0])
        x = matrix(d["vec"], size)
        tree = Tree.build(d["uid"].to_numpy(), d["id"].to_numpy(), x)
        asks = d["asks"].to_numpy(bool)
        found = walk_all(tree, d[asks].assign(worst=LOWEST, tie=HIGHEST), x[asks], k)
        return pd.DataFrame([{"shard": d["shard"].iloc[0], "size": size, **tree.row(), "asked": d["uid"].to_numpy()[asks], "found": found.to_dict("records")}])

    return stored(sharded(rows, SHARD).groupBy("shard").applyInPandas(build, FOREST), "forest")


def open_shards(queries: DataFrame, forest: DataFrame, n_queries: int) -> DataFrame:
    """Queries with the shards, other than their own, whose box reaches their k-th score."""
    groups, parts = max(1, -(-forest.count() // BOXES)), max(1, -(-n_queries // VISITS))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            tops = [(s, z, *(pack(unpack(b, z)[:1]) if z else b"\x02" for b in (lo, hi)), least[0]) for s, z, lo, hi, least in zip(d["shard"], d["size"], d["low"], d["high"], d["least"])]
            yield pd.DataFrame(tops, columns=["shard", "size", "low", "high", "least"])

    tops = forest.select("shard", "size", "low", "high", "least").mapInPandas(boxes, "shard string, size int, low binary, high binary, least long")
    tops = tops.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("p", F.pmod(F.xxhash64(F.lit(3), "uid"), F.lit(parts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["uid", "id", "vec", "worst", "tie"]
        if not len(q) or not len(b):
            return q.iloc[:0][["shard", *names]]
        size = int(q["size"].iloc[0])
        x, low, high, out = matrix(q["vec"], size), matrix(b["low"], size), matrix(b["high"], size), []
        for lo in range(0, len(q), TOGETHER):
            bound = bounds(x[lo : lo + TOGETHER], low, high)
            worst = q["worst"].to_numpy(np.int64)[lo : lo + TOGETHER].astype(np.float64)
            i, j = np.nonzero(bound >= worst[:, None])
            other = q["shard"].to_numpy()[lo + i] != b["shard"].to_numpy()[j]
            out.append(q.iloc[lo + i[other]][names].assign(shard=b["shard"].to_numpy()[j[other]]))
        return pd.concat(out)[["shard", *names]]

    return asked.groupBy("size", "g", "p").cogroup(tops.groupBy("size", "g", "p")).applyInPandas(meet, "shard string, uid long, id long, vec binary, worst long, tie long")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against all other rows."""
    spark = vectors.sparkSession
    usable = vectors.where(F.col(key).isNotNull())
    rows = integer_rows(usable, vector, id=F.col(key).cast("long"), asks=F.coalesce(is_query, F.lit(False)))
    forest = plant(rows, k)
    home = forest.select("shard", F.explode("found").alias("f")).select("shard", "f.*")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    kth = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query").alias("uid"), F.col("score").alias("worst"), F.col("vec_id").alias("tie"))
    own = forest.select("shard", F.explode("asked").alias("uid"))
    asking = rows.where("asks").join(own, "uid").join(kth, "uid", "left")
    asking = asking.select("uid", "id", "size", "vec", "shard", F.coalesce("worst", F.lit(LOWEST)).alias("worst"), F.coalesce("tie", F.lit(HIGHEST)).alias("tie"))
    with batches_of(spark, 16):
        visits = stored(open_shards(asking, forest, rows.where("asks").count()), "visits")
    parts = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("parts"))
    asked = visits.join(parts, "shard").withColumn("p", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    trees = forest.drop("asked", "found").join(parts, "shard").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame(columns=["query", "query_id", "vec_id", "score"], dtype=np.int64)
        tree = Tree.read(t.iloc[0])
        return walk_all(tree, q, matrix(q["vec"], tree.x.shape[1]), k)

    away = asked.groupBy("shard", "p").cogroup(trees.groupBy("shard", "p")).applyInPandas(meet, "query long, query_id long, vec_id long, score long")
    ranked = home.drop("shard").unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_exact_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}
"""
