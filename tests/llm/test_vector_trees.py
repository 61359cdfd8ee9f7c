import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.llm import integer_vectors as iv
from kinforge.llm import op11_kd_search as op11
from kinforge.llm import op13_dual_tree as op13

SCHEMA = "vec_id long, embedding array<double>, score string, cluster string"


def integers(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def plain_search(rows, k=5):
    own = [(i, r[0], integers(r[1])) for i, r in enumerate(rows) if r[0] is not None and integers(r[1]) is not None]
    out = []
    for i, q, x in own:
        if q % 50 == 0:
            held = lambda s: max(-(2**63), min(2**63 - 1, s))
            found = sorted((-held(sum(a * b for a, b in zip(x, y))), v) for j, v, y in own if j != i and len(y) == len(x))[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(found)]
    return sorted(out)


def plain_clusters(rows, k, rounds, dims, seed=2):
    kept = [(r[0], integers(r[1])) for r in rows if r[1] is not None and len(r[1]) == dims and integers(r[1]) is not None]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    w = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(w))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(w)):
            if mine := [v for (_, v), c in zip(kept, at) if c == j]:
                w[j] = [sum(col) // len(mine) for col in zip(*mine)]
    end = [near(v) for _, v in kept]
    by = {j: sum(d for d, c in end if c == j) for j in range(len(w))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in w]
    return sorted(((i, c, d, by[c], sum(by.values()), sha[c]) for (i, _), (d, c) in zip(kept, end)), key=str)


def odd_rows(dims):
    """Nulls, other lengths, repeats, ties, equal vectors, far components."""
    one = [0.5] * dims
    return [
        (100, None), (150, [None] * dims), (200, [float("nan")] * dims), (250, [float("inf")] + one[1:]), (None, one), (300, one), (300, one), (350, [0.25] * dims),
        (350, one), (400, []), (401, []), (450, one[:2]), (451, one[:2]), (452, one[:3]), (500, [0.0] * dims), (550, [-0.001] * dims),
    ]


def mixed(n, dims, seed):
    """Some spread vectors, some in narrow groups, a third equal."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(7, dims))
    x = np.where(rng.random(n)[:, None] < 0.5, rng.normal(size=(n, dims)), mid[rng.integers(0, 7, n)] + 0.02 * rng.normal(size=(n, dims)))
    x[rng.random(n) < 0.33] = mid[0]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) + 1000, x)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "c") for r in rows], SCHEMA).repartition(3)


def small(monkeypatch):
    monkeypatch.setattr(op11, "SHARD", 90)
    monkeypatch.setattr(op11, "LEAF", 8)
    monkeypatch.setattr(op11, "TOGETHER", 3)
    monkeypatch.setattr(op11, "VISITS", 5)
    monkeypatch.setattr(op11, "BOXES", 2)


@pytest.mark.parametrize("dims", [2, 9])
def test_search_equals_brute_force_over_many_shards(spark, monkeypatch, dims):
    small(monkeypatch)
    rows = mixed(900, dims, dims) + odd_rows(dims)
    got = sorted(map(tuple, op11.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_search(rows)


def test_search_of_numbers_beyond_eight_bytes(spark):
    rng = random.Random(5)
    rows = [(i * 25, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 9, 15, 16]) for _ in range(4)]) for i in range(60)]
    got = sorted(map(tuple, op11.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_search(rows)


def test_walk_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    x = (256 * rng.normal(size=(5000, 3))).astype(np.int64)
    tree = op11.Tree.build(np.arange(5000), np.arange(5000), x)
    assert all((x2 >= lo).all() and (x2 <= hi).all() for a, b, lo, hi in zip(tree.start, tree.stop, tree.low, tree.high) for x2 in [tree.x[a:b]])
    seen, real = [], op11.products
    op11.products = lambda q, y: seen.append(len(q) * len(y)) or real(q, y)
    try:
        found = op11.walk(tree, np.arange(40), x[:40], np.full(40, op11.LOWEST), np.full(40, op11.HIGHEST), 5)
    finally:
        op11.products = real
    s = x[:40] @ x.T
    s[np.arange(40), np.arange(40)] = -(10**12)
    assert found == [[(int(s[i, j]), int(j)) for j in np.lexsort((np.arange(5000), -s[i]))[:5]] for i in range(40)]
    assert sum(seen) < 0.5 * 40 * 5000


def test_search_of_empty_and_single(spark):
    assert op11.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert op11.search(frame(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in op11.search(frame(spark, [(50, [1.0]), (51, [-2.0])]), F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 51, -131072)]


@pytest.mark.parametrize("dims", [2, 8])
def test_clusters_equal_brute_force_over_many_shards(spark, monkeypatch, dims):
    monkeypatch.setattr(op13, "SHARD", 120)
    monkeypatch.setattr(op13, "LEAF", 3)
    rows = mixed(700, dims, dims + 20) + odd_rows(dims)
    got = sorted(map(tuple, op13.cluster(frame(spark, rows), k=12, rounds=3, dims=dims).collect()), key=str)
    assert got == plain_clusters(rows, 12, 3, dims)


def test_fewer_vectors_than_centroids_and_far_ones(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e6, -1e6]), (4, [-3e5, 7.0]), (None, [2.0, 2.0])]
    got = sorted(map(tuple, op13.cluster(frame(spark, rows), k=40, rounds=2, dims=2).collect()), key=str)
    assert got == plain_clusters(rows, 40, 2, 2)
    assert op13.cluster(frame(spark, []), dims=2).count() == 0
    assert op13.cluster(frame(spark, [(1, [1.0])]), dims=2).count() == 0
    huge = op13.cluster(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0])]), k=1, rounds=1, dims=2).collect()
    assert len(huge) == 3 and all(0 <= r["distance"] <= r["cluster_inertia"] <= r["inertia"] for r in huge)


@pytest.mark.parametrize("seed", range(6))
def test_cover_tree_holds_its_rules(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, size=(400, 1 + seed)) // (1 + 40 * (seed % 2))
    t = op13.CoverTree.build(x, 4)
    assert sorted(t.order.tolist()) == list(range(400)) and (t.x == x[t.order]).all()
    parent = {int(c): n for n in range(len(t.first)) for c in range(t.first[n], t.first[n] + t.count[n])}
    for n in range(len(t.first)):
        below = range(t.first[n], t.first[n] + t.count[n])
        far = np.sqrt(((t.x[t.start[n] : t.stop[n]] - t.x[t.centre[n]]) ** 2).sum(axis=1))
        assert far.max() == t.radius[n]
        if t.count[n]:
            assert t.centre[n] in {t.centre[c] for c in below} or t.stop[n] > t.start[n]
            assert t.start[t.first[n]] == t.start[n] and all(t.stop[c] == t.start[c + 1] for c in list(below)[:-1])
        elif t.radius[n] > 0:
            assert t.stop[n] - t.start[n] <= 4 or parent.get(n) is None
    goals = op13.CoverTree.build(x[:30], 1)
    d = ((t.x[:, None, :] - x[None, :30, :]) ** 2).sum(axis=2)
    assert op13.nearest_centroids(t, goals).tolist() == d.argmin(axis=1).tolist()


def test_pack_keeps_every_width():
    for most in (3, 2**15 - 1, 2**15, 2**31, 2**62):
        x = np.array([[most, -most, 0]], np.int64)
        assert (iv.unpack(iv.pack(x), 3) == x).all()


def test_given_vectors_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op11.op11_exact_search(spark, "/root/testdata/sf0.1").collect())) == plain_search(rows)
