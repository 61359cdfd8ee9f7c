import random

import numpy as np
from pyspark.sql import functions as F

from kinforge.llm import op3_quotes as op3
from kinforge.llm import op5_neighbours as op5
from kinforge.llm import op8_mixing as op8
from kinforge.llm import op9_pii as op9
from kinforge.llm import op10_decontam as op10

DOC = "doc_id long, text string, source string"


# -- quotations
def test_quotations_link_and_order(spark):
    rows = [
        (1, 0, "user", "How are you?\n\nTell me more."), (1, 1, "bot", "> how are  you?\n\nFine."), (1, 2, "user", ">> How are you?\n> Fine.\nGood."), (1, 3, "user", "> Tell me more.\nNo."),
        (1, 4, "user", "> never said\nWhat?"), (2, 0, "user", None), (2, 1, "user", ""), (2, 2, None, "> How are you?"),
    ]
    t = op3.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r["conv_id"], r["turn"]): r for r in t.collect()}
    assert len(out) == len(rows)
    assert [out[1, k]["parent_turn"] for k in range(5)] == [None, 0, 1, 0, None]
    assert out[1, 2]["path"] == [0, 1, 2] and out[1, 2]["depth"] == 2 and out[1, 2]["n_links"] == 2
    assert out[1, 1]["text"] == "Fine." and out[2, 2]["parent_turn"] is None and out[2, 2]["text"] == ""


def test_lines_owned_and_quoted_many_times(spark):
    """The latest earlier owner of each quoted line, by trying all."""
    rng = random.Random(4)
    rows = [(t % 3, t, "user", ("> ok\n" if rng.random() < 0.4 else "> line\n" if rng.random() < 0.3 else "") + rng.choice(["ok", "line", f"own {t}"])) for t in range(120)]
    got = {r["turn"]: r["parent_turn"] for r in op3.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, _, text in rows:
        quoted = [x[2:] for x in text.split("\n") if x.startswith("> ")]
        own = [o for c2, o, _, other in rows if c2 == c and o < t and other.split("\n")[-1] in quoted]
        assert got[t] == (max(own) if own else None)


# -- neighbours
def test_neighbours_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[10] = x[20] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op5.nearest(v, F.col("vec_id") % 100 == 0).toPandas()
    hit, scale = 0, x.astype(np.float64)
    for q, g in got.groupby("query_id"):
        s = scale @ scale[q]
        s[q] = -np.inf
        hit += len({*g["vec_id"]} & {*np.lexsort((np.arange(len(s)), -s))[:20].tolist()})
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]])
    assert got["query_id"].nunique() == 30 and hit / 600 >= 0.9


def test_one_far_longer_vector_leaves_the_others_theirs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(401, 16)).astype(np.float32)
    x[400] = [1e30] + [0] * 15
    got = op5.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    s, hit = x.astype(np.float64) @ x.astype(np.float64).T, 0
    np.fill_diagonal(s, -np.inf)
    for q, g in got.groupby("query_id"):
        hit += len({*g["vec_id"]} & {*np.lexsort((np.arange(401), -s[q]))[:20].tolist()})
    assert hit / (21 * 20) >= 0.9


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5, "BLOCK", 700)
    rng = np.random.default_rng(17)
    mid = rng.normal(size=(60, 24))
    x = (mid[rng.integers(0, 60, 12_000)] + 0.7 * rng.normal(size=(12_000, 24))).astype(np.float32)
    got = op5.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    d, hit = x.astype(np.float64), 0
    for q, g in got.groupby("query_id"):
        s = d @ d[q]
        s[q] = -np.inf
        hit += len({*g["vec_id"]} & {*np.argsort(-s, kind="stable")[:20].tolist()})
    assert got["query_id"].nunique() == 240 and hit / (240 * 20) >= 0.9


def test_few_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op5.nearest(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


# -- mixing
def fill(sizes, weights, total):
    open_, target, left = set(sizes), {}, total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "b") for i in range(500)] + [(600, None, "a"), (601, " \t", "e"), (7, "x y", "a")]
    docs = spark.createDataFrame(rows, DOC)
    plan = op8.plan_mix(docs)
    out = plan.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert plan.count() == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    sizes, order = {}, sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    for s in order:
        mine = [r for r in out if r["source"] == s and r["doc_id"] != 7]
        assert abs(mine[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - want[s]) <= 3 * op8.BLOCK
    mixed = op8.mix(docs, plan)
    assert mixed.agg(F.sum(op8.word_count(F.col("text")))).first()[0] == plan.agg(F.sum("taken")).first()[0]
    assert mixed.columns == docs.columns


def test_sainte_lague_against_quotients(spark):
    rng = random.Random(9)
    for seats in (0, 1, 17, 100):
        votes = [rng.randint(0, 90) for _ in range(9)] + [1]
        won = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        d = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, i int, v double, s int")
        assert [r["quota"] for r in op8.sainte_lague(d, ["g"], "v", "s", [F.col("i")]).orderBy("i").collect()] == won


def test_seats_times_votes_beyond_a_long(spark):
    d = spark.createDataFrame([(0, 0, 4_000_000_000, 8_000_000_000), (0, 1, 4_000_000_000, 8_000_000_000)], "g int, i int, v long, s long")
    assert [r["quota"] for r in op8.sainte_lague(d, ["g"], "v", "s", [F.col("i")]).orderBy("i").collect()] == [4_000_000_000] * 2


def test_mixing_rows_without_ids(spark):
    docs = spark.createDataFrame([(None if i % 2 else -1, f"a b c d{i % 7}", "s") for i in range(200)], DOC)
    plan = op8.plan_mix(docs)
    assert op8.mix(docs, plan).agg(F.sum(op8.word_count(F.col("text")))).first()[0] == plan.agg(F.sum("taken")).first()[0]


# -- personal data
def test_surrogates(spark):
    text = "Mail ana.b@mail.example.com or ana.b@mail.example.com, 10.0.0.1, card 4539 1488 0343 6467. Mr. Peter Novak and Dr. Novak."
    docs = spark.createDataFrame([(1, text, "s"), (2, "only peter@x.org here", "s"), (3, None, "s"), (4, "", "s"), (5, "plain", "s")], DOC)
    out = {r["doc_id"]: r for r in op9.replace(docs).collect()}
    new = out[1]["text"]
    assert out[1]["n_entities"] == 6 and out[5]["text"] == "plain" and out[3]["text"] is None and len(out) == 5
    assert not any(x in new for x in ("ana.b@", "10.0.0.1", "4539 1488", "Novak"))
    mails = [w.strip(",") for w in new.split() if "@" in w]
    assert mails[0] == mails[1]
    surname = new.split("Dr. ")[1].rstrip(".")
    assert surname in new.split("Dr.")[0] and new.split("Mr. ")[1].split()[0] in op9.GIVEN["m", "latin"]
    digits = [int(c) for c in new.split("card ")[1][:19] if c.isdigit()]
    assert digits[0] == 4 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0


def test_surrogates_are_distinct(spark):
    values = spark.createDataFrame([("token", f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(676)] + [("ip", f"1.2.{i // 250}.{i % 250}") for i in range(1000)], "kind string, value string")
    out = op9.distinct_surrogates(values)
    assert out.count() == 1676 and out.select("kind", "surrogate").distinct().count() == 1676


# -- decontamination
def test_leaks_against_brute_force(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((3, 5, 9, 17, 40, 60))] + [(50, None), (51, "")]
    rows = []
    for i, (_, t) in enumerate(items[:6]):
        long = rng.choices(words, k=3000)
        rows.append((i, " ".join(long[:1500] + t.upper().split() + long[1500:]), "s"))
        rows.append((100 + i, " ".join(long[:700] + t.split()[: len(t.split()) // 2] + long[700:]), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, items[0][1], "s")]

    def shingles(t, k):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, x in items:
        k = min(5, len((x or "").split()))
        mine = shingles(x, k) if k else set()
        want |= {(d, i) for d, t, _ in rows if mine and len(mine & shingles(t, k)) / len(mine) >= 0.8}
    assert {0, 202} <= {d for d, i in want if i == 0}  # three words inside a long text and alone
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op10.leaks(docs, bench).collect()} == want
    assert op10.leaks(docs, bench.limit(0)).count() == 0
    assert op10.clean(docs, bench).count() == len(rows) - len({d for d, _ in want})


def test_mixing_with_many_sources_and_nothing(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (50 + i % 7)), f"s{i % 5}", "x", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC + ", size string, taken int")
    few = {(r["doc_id"], r["taken"]) for r in op8.plan_mix(docs).collect()}
    monkeypatch.setattr(op8, "SIDE_LIMIT", 0)
    plan = op8.plan_mix(docs)
    assert {(r["doc_id"], r["taken"]) for r in plan.collect()} == few and op8.mix(docs, plan).columns == docs.columns
    assert op8.plan_mix(docs.limit(0)).count() == 0


def test_neighbours_of_any_finite_vector(spark):
    rows = [(0, [1e300, 0.0], "x"), (20, [1.0, 0.0], "y"), (1, [1e-300, 1e-300], "z"), (40, [1.0, 2.0, 3.0], "w"), (2, [0.5, 0.5, 0.5], "w"), (60, [float("inf"), 1.0], "v"), (80, [], "v")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in op5.nearest(v, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (20, 1e300), (0, 2): (1, 1.0), (20, 1): (0, 1e300), (20, 2): (1, 1e-300), (40, 1): (2, 3.0)}
    assert op5.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0
