"""Lloyd's clustering by two trees: cover trees over the vectors, and one over the centroids per round.

Vectors are in shards of near vectors (``integer_vectors``), each of which becomes a cover tree once, kept
in the shared folder: centres of a level cover their points within 2^level and lie further apart than
that; every node knows the largest distance of its points from its centre. In a round a tree of the
centroids is built by the same rule, and pairs of nodes are gone through from both roots: a pair is
dropped if its least possible distance exceeds what another centroid is sure to have, and the wider node
of the others is opened. A node left with one centroid is assigned as a whole; the points of leaves are
compared with the centroids of the leaves that are left, in exact integers. Tasks send sums for each
centroid, which Spark adds up; the driver sees as many rows as centroids have components.

Defined cases: only vectors of exactly ``dims`` components, none null or non-finite, are kept; a null id is
assigned but is no start; with fewer vectors than centroids, all are starts; starts of equal hash are told
apart by their components; ties go to the smaller centroid; a distance or sum beyond the range of long is
held at its end; an empty table gives no rows; columns other than id and vector are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, table
from .integer_vectors import LONG, SCALE, integer_rows, largest, matrix, pack, sharded, squares, unpack

CENTROIDS, ROUNDS, DIMS, SEED = 40, 5, 64, 2
SHARD = 4096
LEAF = 16
#: shards in one Arrow batch
BATCH = 4
FOREST = "shard string, ids array<long>, named array<boolean>, vecs binary, centres array<int>, starts array<int>, stops array<int>, radii array<double>, firsts array<int>, counts array<int>"


class CoverTree:
    """``x`` in depth-first order; node n covers rows start[n]:stop[n], its children are first[n] and count[n] - 1 more."""

    def __init__(self, order, x, centre, start, stop, radius, first, count):
        self.order, self.x, self.centre, self.start, self.stop, self.radius, self.first, self.count = order, x, centre, start, stop, radius, first, count

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> CoverTree:
        f = x.astype(np.float64)

        def far(i: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(((f[i] - f[c]) ** 2).sum(axis=1))

        n = len(x)
        owner, away = np.zeros(n, np.int64), far(np.arange(n), 0)
        children: list[list[int]] = [[]]
        centre, now = [0], {0: 0}  # centres by node; the lowest node of each centre
        level = int(np.ceil(np.log2(max(1.0, away.max())))) + 1
        open_points = np.arange(n)
        while True:
            # nodes that are small, or whose points are all equal, stay leaves
            sizes = np.bincount(owner[open_points], minlength=n)
            wide = np.zeros(n, bool)
            wide[owner[open_points][away[open_points] > 0]] = True
            open_points = open_points[(sizes > leaf)[owner[open_points]] & wide[owner[open_points]]]
            if not len(open_points):
                break
            level -= 1
            reach = 2.0 ** (level - 1)
            loose = open_points[away[open_points] > reach]
            for c in np.unique(owner[open_points]).tolist():  # another centre of the level may cover them
                if not len(loose):
                    break
                d = far(loose, c)
                near = d <= reach
                owner[loose[near]], away[loose[near]] = c, d[near]
                loose = loose[~near]
            fresh: dict[int, list[int]] = {}
            while len(loose):
                c = int(loose[0])
                fresh.setdefault(int(owner[c]), []).append(c)
                d = far(loose, c)
                near = d <= reach
                near[0] = True
                owner[loose[near]], away[loose[near]] = c, d[near]
                away[c] = 0.0
                loose = loose[~near]
            parents = {p: now[p] for p in fresh}
            for p, made in fresh.items():
                for c in [p, *made]:
                    children[parents[p]].append(len(centre))
                    now[c] = len(centre)
                    centre.append(c)
                    children.append([])
        return cls._flat(x, f, owner, centre, now, children)

    @classmethod
    def _flat(cls, x, f, owner, centre, now, children) -> CoverTree:
        """Nodes breadth first, points depth first; nodes without points are left out."""
        by_owner = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[by_owner], np.arange(len(x) + 1))
        points = {now[c]: by_owner[first[c] : first[c + 1]] for c in now}
        total = [len(points.get(k, ())) for k in range(len(centre))]
        for k in range(len(centre) - 1, -1, -1):  # children have larger numbers than their parents
            total[k] += sum(total[c] for c in children[k])
        order, start = np.zeros(len(x), np.int64), [0] * len(centre)
        nodes, kept = [0], []
        place = {0: 0}
        for k in nodes:
            below = [c for c in children[k] if total[c]]
            kept.append((place[k], len(below)))
            at = start[k]
            own = points.get(k, ())
            order[at : at + len(own)] = own
            at += len(own)
            for c in below:
                place[c], start[c] = len(nodes), at
                at += total[c]
                nodes.append(c)
        counts = np.array([c for _, c in kept], np.int64)
        firsts = 1 + np.cumsum(counts) - counts
        start, stop = np.array([start[k] for k in nodes]), np.array([start[k] + total[k] for k in nodes])
        mid = np.array([centre[k] for k in nodes])
        radius = np.array([np.sqrt(((f[order[a:b]] - f[c]) ** 2).sum(axis=1)).max() for a, b, c in zip(start, stop, mid)])
        where = np.empty(len(x), np.int64)
        where[order] = np.arange(len(x))
        return cls(order, x[order], where[mid], start, stop, radius, firsts, counts)


def opened(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of the nodes, and for each the place of its parent in ``nodes``."""
    count = tree.count[nodes]
    parent = np.repeat(np.arange(len(nodes)), count)
    step = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
    return tree.first[nodes][parent] + step, parent


def crossed(tree: CoverTree, nodes: np.ndarray, other: CoverTree, others: np.ndarray) -> np.ndarray:
    """Distances of the centres of the pairs, by one product of those that occur."""
    a, at = np.unique(nodes, return_inverse=True)
    b, bt = np.unique(others, return_inverse=True)
    x, c = (t.x[t.centre[k]].astype(np.float64) for t, k in ((tree, a), (other, b)))
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(d, 0))[at, bt]


def nearest_centroids(tree: CoverTree, goals: CoverTree) -> np.ndarray:
    """For each row of the tree the number of its nearest centroid; ties: the smallest."""
    k = len(goals.x)
    label = np.full(len(tree.x), -1, np.int64)
    slack = 1e-6 * (1 + largest(tree.x, goals.x)) * max(1, tree.x.shape[1]) ** 0.5
    single = (goals.stop - goals.start == 1) & (goals.count == 0)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    a = b = np.zeros(1, np.int64)
    while len(a):
        d = crossed(tree, a, goals, b)
        sure = np.full(len(tree.start), np.inf)
        np.minimum.at(sure, a, d + tree.radius[a])
        keep = d - tree.radius[a] - goals.radius[b] <= sure[a] + slack
        a, b = a[keep], b[keep]
        left = np.bincount(a, minlength=len(tree.start))
        one = (left[a] == 1) & single[b]
        for n, g in zip(a[one].tolist(), b[one].tolist()):
            label[tree.start[n] : tree.stop[n]] = goals.order[goals.start[g]]
        a, b = a[~one], b[~one]
        # per node: open it if it is wider than all its partners, else open those
        wide = np.zeros(len(tree.start))
        np.maximum.at(wide, a, goals.radius[b])
        inner = np.zeros(len(tree.start), bool)
        inner[a[goals.count[b] > 0]] = True
        open_a = (tree.count[a] > 0) & ((tree.radius[a] > wide[a]) | ~inner[a])
        done = ~open_a & ~inner[a]
        leaves.append((a[done], b[done]))
        split = ~open_a & ~done
        up, at = opened(tree, np.unique(a[open_a]))
        pairs = pd.DataFrame({"parent": np.unique(a[open_a])[at], "a": up}).merge(pd.DataFrame({"parent": a[open_a], "b": b[open_a]}), on="parent")
        stay = split & (goals.count[b] == 0)
        go = np.flatnonzero(split & (goals.count[b] > 0))
        down, of = opened(goals, b[go])
        a, b = np.concatenate([pairs["a"].to_numpy(np.int64), a[stay], a[go][of]]), np.concatenate([pairs["b"].to_numpy(np.int64), b[stay], down])
    compare(tree, goals, np.concatenate([x for x, _ in leaves]), np.concatenate([y for _, y in leaves]), k, label)
    return label


def compare(tree: CoverTree, goals: CoverTree, a: np.ndarray, b: np.ndarray, k: int, label: np.ndarray) -> None:
    """Exact comparison of the points of leaves; leaves with the same centroids left go together."""
    nodes, at = np.unique(a, return_inverse=True)
    left = np.zeros((len(nodes), k), bool)
    for g in np.unique(b).tolist():
        for c in goals.order[goals.start[g] : goals.stop[g]].tolist():
            left[at[b == g], c] = True
    kinds, kind = np.unique(np.packbits(left, axis=1), axis=0, return_inverse=True)
    numbered = np.empty_like(goals.x)
    numbered[goals.order] = goals.x
    for t in range(len(kinds)):
        mine = np.flatnonzero(kind.ravel() == t)
        chosen = np.flatnonzero(left[mine[0]])
        rows = np.concatenate([np.arange(tree.start[n], tree.stop[n]) for n in nodes[mine]])
        label[rows] = chosen[squares(tree.x[rows], numbered[chosen]).argmin(axis=1)]


def plant(rows: DataFrame) -> DataFrame:
    """One row a shard: its cover tree."""

    def build(d: pd.DataFrame) -> pd.DataFrame:
        t = CoverTree.build(matrix(d["vec"], int(d["size"].iloc[0])))
        row = {"shard": d["shard"].iloc[0], "ids": d["id"].to_numpy()[t.order], "named": d["named"].to_numpy(bool)[t.order], "vecs": pack(t.x)}
        return pd.DataFrame([row | {"centres": t.centre, "starts": t.start, "stops": t.stop, "radii": t.radius, "firsts": t.first, "counts": t.count}])

    return stored(sharded(rows, SHARD).groupBy("shard").applyInPandas(build, FOREST), "forest")


def trees(d: pd.DataFrame, dims: int) -> Iterator[tuple[CoverTree, np.ndarray, np.ndarray]]:
    for r in d.to_dict("records"):
        yield CoverTree(None, unpack(r["vecs"], dims), *(np.asarray(r[c]) for c in ("centres", "starts", "stops", "radii", "firsts", "counts"))), np.asarray(r["ids"]), np.asarray(r["named"], bool)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids of what is nearest to each."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goals, total, count = CoverTree.build(centroids, 1), np.zeros((k, dims), object), np.zeros(k, np.int64)
        for d in batches:
            for t, _, _ in trees(d, dims):
                label = nearest_centroids(t, goals)
                kind = np.float64 if largest(t.x) * len(t.x) < 2**53 else object
                member = (label[None, :] == np.arange(k)[:, None]).astype(kind)
                part = member @ t.x.astype(kind)
                total += part.astype(np.int64).astype(object) if kind is np.float64 else part
                count += np.bincount(label, minlength=k)
        hit = np.flatnonzero(count)
        at = np.tile(np.arange(dims), len(hit))
        yield pd.DataFrame({"c": np.repeat(hit, dims), "at": at, "total": [Decimal(int(v)) for v in total[hit].ravel()], "n": np.repeat(count[hit], dims)})

    with batches_of(forest.sparkSession, BATCH):
        parts = forest.mapInPandas(sums, "c int, at int, total decimal(38,0), n long")
        rows = parts.groupBy("c", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["c"], r["at"]] = int(r["total"]) // r["n"]
    return out


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goals = CoverTree.build(centroids, 1)
        for d in batches:
            for t, ids, named in trees(d, dims):
                label = nearest_centroids(t, goals)
                kind = np.int64 if 4 * largest(t.x, centroids) ** 2 * dims < 2**63 else object
                apart = t.x.astype(kind) - centroids.astype(kind)[label]
                distance = np.minimum((apart * apart).sum(axis=1), LONG[1]).astype(np.int64)
                yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "cluster": label.astype(np.int32), "distance": distance}).assign(vec_id=lambda f: f["vec_id"].where(named))

    with batches_of(forest.sparkSession, BATCH):
        return stored(forest.mapInPandas(run, "vec_id long, cluster int, distance long"), "assigned")


def starts(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The vectors of the smallest hashes, in that order."""
    hashed = rows.where("named").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vec")
    return np.array([unpack(bytes(r["vec"]), dims)[0] for r in hashed.orderBy("h", "vec").limit(k).collect()], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with ``dims`` components."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors.where(F.size(vector) == dims), vector, id=F.coalesce(F.col(key), F.lit(0)).cast("long"), named=F.col(key).isNotNull())
    centroids = starts(rows, k, seed, dims)
    if not len(centroids):  # nothing to start from, so nothing to be near to
        return rows.where(F.lit(False)).select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *[F.col("id").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    forest = plant(rows)
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    out = assigned(forest, centroids)
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), LONG[1])
    named = [(c, min(s, LONG[1]), inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    clusters = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each of the k centroids at most
    return out.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_dual_tree_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after another, by brute force, in DuckDB's SQL."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR)) - 1 AS c, v AS w FROM kept WHERE vec_id IS NOT NULL
  QUALIFY c < {CENTROIDS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT uid, vec_id, v, arg_min(c, d * 1000 + c) AS c, min(d) AS d
  FROM (SELECT uid, vec_id, v, c, list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d FROM kept, c{r})
  GROUP BY uid, vec_id, v)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIMS} + 1) t(i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT c, w FROM c{r} WHERE c NOT IN (SELECT c FROM s{r})
  UNION ALL SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS w FROM s{r} GROUP BY c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""


SQL = _sql()
