"""Closures read their edges where they lie: no round shuffles them again, and nothing stays in memory."""

from kinforge.operators import graph


def test_no_round_spreads_the_edges_again(spark, monkeypatch):
    pairs = spark.createDataFrame([("f", f"@I{i}@", f"@I{2 * i + j}@") for i in range(1, 16) for j in (0, 1)], "file string, parent string, child string")
    seeds = spark.createDataFrame([("f", "@I2@")], "file string, id string")
    plans, cut, held = [], graph.cut, lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    monkeypatch.setattr(graph, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    got = {(r["id"], r["depth"]) for r in graph.closure(pairs, seeds, "parent", "child").collect()}
    assert got == {("@I2@", 0)} | {(f"@I{i}@", 1) for i in (4, 5)} | {(f"@I{i}@", 2) for i in range(8, 12)} | {(f"@I{i}@", 3) for i in range(16, 24)}
    rounds = [p for p in plans if "parent" in p and "SortMergeJoin" in p]
    assert len(rounds) == 4 and all("InMemoryTableScan" in p for p in rounds)
    assert held() == before
