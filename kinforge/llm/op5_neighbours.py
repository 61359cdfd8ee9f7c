"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node, named by its least id. The graph starts from blocks of nodes on the
same side of seeded hyperplanes, in which each node takes its best neighbours; blocks have about
``BLOCK`` nodes at most, however large the table is. Then, in rounds, the neighbours and sampled
reverse neighbours of each node meet at it (a Spark join of neighbours of neighbours), and every
pair of them of which one is new to the node offers itself to either end if it beats that end's
worst neighbour, until hardly an edge changes. Queries start at their own node's neighbours and
expand the best nodes of their beam until none is left unexpanded; the beam grows with the
logarithm of the table. Vectors travel as 8-bit numbers with a scale relative to the largest
component of all (a double); what the search finds is ranked by the inner product of the original vectors in
double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, any other finite vector does; vectors of different lengths are never compared; equal vectors
and repeated ids rank by smaller id; with fewer candidates than asked for, all are returned; empty
tables give no rows; columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored, table

K = 48
REVERSE = 32
SETTLED = 0.02
BLOCK = 2400
BLOCKINGS = 4
#: a query's beam holds so many nodes for each doubling of the table
BEAM = 48
#: queries that expand one node in one group of rows
MEET = 4096
TOP = 20
SEED = 97


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unpack(packed: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return raw[:, 8:].view(np.int8).astype(np.float64) * raw[:, :8].copy().view(np.float64)


def packed_nodes(nodes: DataFrame, largest: float) -> DataFrame:
    """``id, vec``: a scale of 8 bytes, so that one far longer vector leaves the others theirs, and signed bytes, of the vector over ``largest``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in d["vector"]])
            own = np.abs(x).max(axis=1, keepdims=True)
            small = np.rint(x / own * 127).astype(np.int8)
            raw = np.concatenate([(own / largest / 127).view(np.uint8).reshape(len(x), 8), small.view(np.uint8)], axis=1)
            yield pd.DataFrame({"id": d["id"], "vec": [r.tobytes() for r in raw]})

    return nodes.mapInPandas(run, "id long, vec binary")


def block_edges(nodes: DataFrame, n: int, turn: int) -> DataFrame:
    """Edges (u, v, s) to the best neighbours within blocks of nearby nodes; blocks have a bounded size."""
    bits = max(0, int(np.log2(max(1, n / (BLOCK * 0.7)))))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            x = _unpack(d["vec"])
            planes = np.random.default_rng(SEED + turn).normal(size=(x.shape[1], max(bits, 1)))
            c = ((x @ planes) > 0) @ (1 << np.arange(max(bits, 1))) if bits else np.zeros(len(x), np.int64)
            yield d.assign(code=c.astype(np.int64))

    def best(d: pd.DataFrame) -> pd.DataFrame:
        ids, x = d["id"].to_numpy(), _unpack(d["vec"])
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(K, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": [], "v": [], "s": []})
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()})

    coded = nodes.mapInPandas(code, "id long, vec binary, code long")
    parts = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    split = coded.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts")))
    return split.select("id", "vec", "code", "part").groupBy("code", "part").applyInPandas(best, "u long, v long, s double")


def merged(edges: DataFrame) -> DataFrame:
    """The K best (u, v, s, new) of each u; an edge is new if no older copy of it is there."""
    one = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    ranked = one.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.col("s").desc(), "v")))
    return ranked.where(F.col("r") <= K).drop("r")


def met(members: DataFrame, search: bool) -> DataFrame:
    """Offers (u, v, s) among the rows (c, part, a, f, vec, tau) that meet at the same part of c.

    Building: pairs of which one has ``f`` (is new), offered to either end it improves on.
    Searching: rows with ``f`` are queries, the others nodes, offered to the queries.
    """

    def offers(c: np.ndarray, d: pd.DataFrame) -> pd.DataFrame:
        a, f, tau, x = d["a"].to_numpy(), d["f"].to_numpy().astype(bool), d["tau"].to_numpy(), _unpack(d["vec"])
        borders = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        us, vs, ss = [], [], []
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            m, ids, new = x[lo:hi], a[lo:hi], f[lo:hi]
            if search:
                q, w = np.flatnonzero(new), np.flatnonzero(~new)
                if not len(q) or not len(w):
                    continue
                s = m[q] @ m[w].T
                i, j = np.nonzero(s > tau[lo:hi][q][:, None])
                i2, j2 = q[i], w[j]
            else:
                if hi - lo < 2 or not new.any():
                    continue
                s = m @ m.T
                i, j = np.nonzero((s > tau[lo:hi][:, None]) & (new[:, None] | new[None, :]))
                i2, j2 = i, j
            keep = ids[i2] != ids[j2]
            us.append(ids[i2][keep])
            vs.append(ids[j2][keep])
            ss.append(s[i, j][keep])
        if not us:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "s": np.zeros(0, np.float64)})
        out = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(ss)})
        return out.drop_duplicates(["u", "v"])

    def place(d: pd.DataFrame) -> np.ndarray:
        """The running number of each row's (c, part)."""
        c, part = d["c"].to_numpy(), d["part"].to_numpy()
        return np.cumsum(np.concatenate([[0], (c[1:] != c[:-1]) | (part[1:] != part[:-1])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for d in batches:
            d = d if rest is None else pd.concat([rest, d], ignore_index=True)
            if not len(d):
                continue
            c = place(d)
            cut = int(np.searchsorted(c, c[-1]))  # the last group's rows may go on in the next batch
            if cut:
                yield offers(c[:cut], d.iloc[:cut])
            rest = d.iloc[cut:]
        if rest is not None and len(rest):
            yield offers(place(rest), rest)

    sorted_members = members.repartition("c", "part").sortWithinPartitions("c", "part")
    return sorted_members.mapInPandas(run, "u long, v long, s double")


def reverse_of(graph: DataFrame, fresh_first: bool = True) -> DataFrame:
    """At most REVERSE sampled (c, a, f) with an edge a -> c."""
    order = [F.col("new").desc()] if fresh_first else [F.col("s").desc()]
    r = F.row_number().over(W.partitionBy("v").orderBy(*order, F.xxhash64("u", "v")))
    return graph.withColumn("r", r).where(F.col("r") <= REVERSE).select(F.col("v").alias("c"), F.col("u").alias("a"), F.col("new").alias("f"))


def build_graph(nodes: DataFrame) -> DataFrame:
    """NN-descent over ``id, vec``: rows (u, v, s, new)."""
    n = nodes.count()
    start = block_edges(nodes, n, 0)
    for turn in range(1, BLOCKINGS if n > BLOCK else 1):  # a single block is the same in every turn
        start = start.unionByName(block_edges(nodes, n, turn))
    graph = stored(merged(start.withColumn("new", F.lit(True))), "graph")
    while True:
        worst = graph.groupBy("u").agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("id"), F.when(F.col("c") >= K, F.col("low")).otherwise(F.lit(float("-inf"))).cast("double").alias("tau"))
        ends = nodes.join(worst, "id", "left").select(F.col("id").alias("a"), "vec", F.coalesce("tau", F.lit(float("-inf")).cast("double")).alias("tau"))
        both = graph.select(F.col("u").alias("c"), F.col("v").alias("a"), F.col("new").alias("f")).unionByName(reverse_of(graph))
        offers = met(both.join(ends, "a").select("c", F.lit(0).alias("part"), "a", "f", "vec", "tau"), search=False)
        old = graph.select("u", "v", "s", F.lit(False).alias("new"))
        before, graph = graph, stored(merged(old.unionByName(offers.withColumn("new", F.lit(True)))), "graph")
        discard(before)
        if graph.where("new").count() <= SETTLED * K * n:
            return graph


def beam_for(n: int) -> int:
    return BEAM * max(2, int(np.ceil(np.log2(max(n, 1) / 500))))


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int) -> DataFrame:
    """Greedy search from each query node (column q): its beam (q, v, s)."""
    found = graph.join(queries.select(F.col("q").alias("u")), "u", "left_semi").select(F.col("u").alias("q"), "v", "s", F.lit(False).alias("done"))
    adjacent = stored(graph.select(F.col("u").alias("c"), F.col("v").alias("a")).unionByName(reverse_of(graph, False).select("c", "a")).distinct(), "adjacent")
    low = F.lit(float("-inf")).cast("double")
    before = None
    while True:
        w = W.partitionBy("q").orderBy(F.col("s").desc(), "v")
        ranked = stored(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam), "beam")
        discard(before)
        before = ranked
        open_nodes = ranked.where("not done").select("q", F.col("v").alias("c"))
        if open_nodes.isEmpty():
            return ranked.select("q", "v", "s")
        tau = ranked.groupBy("q").agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("n")).select("q", F.when(F.col("n") >= beam, F.col("low")).otherwise(low).cast("double").alias("tau"))
        parts = open_nodes.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts"))  # a hub's queries are split
        ask = open_nodes.join(parts, "c").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
        ask = ask.join(tau, "q").join(nodes.select(F.col("id").alias("q"), "vec"), "q").select("c", "part", F.col("q").alias("a"), F.lit(True).alias("f"), "vec", "tau")
        near = adjacent.join(parts, "c").join(nodes.select(F.col("id").alias("a"), "vec"), "a").select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", F.lit(False).alias("f"), "vec", low.alias("tau"))
        offers = met(ask.unionByName(near), search=True).select(F.col("u").alias("q"), "v", "s", F.lit(False).alias("done"))
        old = ranked.select("q", "v", "s", F.lit(True).alias("done"))
        found = old.unionByName(offers).groupBy("q", "v").agg(F.max("s").alias("s"), F.max("done").alias("done"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against all rows."""
    own = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = own.groupBy(F.size("vector").alias("n")).agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("largest")).orderBy("n").collect()
    if not sizes:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    return reduce(DataFrame.unionByName, [_nearest(own.where(F.size("vector") == r["n"]), r["largest"], top) for r in sizes])


def _nearest(own: DataFrame, largest: float, top: int) -> DataFrame:
    """``nearest`` for usable vectors of one length."""
    own = own.withColumn("h", F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit(SEED), "vector").alias("y")))
    names = own.groupBy("h").agg(F.min("vec_id").alias("id"))
    own = stored(own.join(names, "h").select("vec_id", "id", "vector", "asks"), "vectors")
    first = own.where("vec_id = id").dropDuplicates(["id"]).select("id", "vector")
    nodes = stored(packed_nodes(first, largest), "nodes")
    graph = build_graph(nodes)
    asking = own.where("asks").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).distinct()
    qnodes = asking.select("q").distinct()
    beam = search(graph, nodes, qnodes, beam_for(nodes.count()))
    self_pairs = qnodes.select("q", F.col("q").alias("v"))
    pairs = stored(beam.select("q", "v").unionByName(self_pairs).distinct(), "pairs")
    scored = pairs.join(first.select(F.col("id").alias("q"), F.col("vector").alias("x")), "q").join(first.select(F.col("id").alias("v"), F.col("vector").alias("y")), "v").select("q", "v", dot("x", "y").alias("score"))
    # a node's least ids: one more than a query can use, as it may itself be among them
    least = own.select("vec_id", F.col("id").alias("v")).distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "v"))).where(F.col("r") <= top + 1)
    ids = best.select("q", "v", "score").join(least, "v").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= top + 1)
    # equal query vectors share a list; each drops itself from it
    out = asking.join(ids.select("q", "vec_id", "score"), "q").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return out.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
