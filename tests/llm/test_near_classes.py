import random

from kinforge.llm import op6_near_dedup as op6


def words5(text):
    w = text.split()
    k = min(5, len(w))
    seen, out = {}, []
    for i in range(len(w) - k + 1) if w else ():
        s = tuple(w[i : i + k])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def chain(a, b):
    """Similarity by the plain dynamic program of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    m = row[-1]
    return m / (len(a) + len(b) - m) if a and b else 0.0


def plain_classes(rows):
    """Least id of every component, by union to a fixed point."""
    parts = {i: words5((t or "").lower()) for i, t in rows}
    label = {i: i for i in parts}
    pairs = [(i, j) for i in parts for j in parts if i < j and parts[i] and (parts[i] == parts[j] or chain(parts[i], parts[j]) >= op6.SIMILAR)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    return label


def test_edited_copies_and_common_passages(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(600)}"
    base, common = [word() for _ in range(70)], [word() for _ in range(45)]
    rows = []
    for k in range(40):  # copies with more and more edits, and copies of copies
        w = list(base if k % 2 else (rows[-1][1].split() if rows else base))
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    for _ in range(25):  # texts that share most of their words, yet are not near
        rows.append((len(rows), " ".join(common + [word() for _ in range(20)])))
    pair = common + [word() for _ in range(20)]
    rows += [(200, " ".join(pair)), (201, " ".join([*pair[:-1], "end"])), (300, None), (301, ""), (302, "one two"), (303, "one two"), (304, rows[0][1])]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, label string, w int")
    got = {r["doc_id"]: r["class_id"] for r in op6.near_classes(d).collect()}
    assert got == plain_classes(rows)
    kept = op6.keep_one(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == d.columns


def test_one_id_on_unrelated_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    d = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (None, a)], "doc_id long, text string")
    got = {(r["doc_id"], r["h1"]): r["class_id"] for r in op6.near_classes(d).collect()}
    assert len(set(got.values())) == 2 and len(got) == 4
    assert sorted(((r["doc_id"], r["text"]) for r in op6.keep_one(d).collect()), key=str) == sorted([(1, a), (1, b), (None, a)], key=str)


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert op6.near_classes(d).count() == 0 and op6.keep_one(d).count() == 0


def test_long_texts_around_a_common_one_hide_no_link(spark):
    rng = random.Random(60)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [word() for _ in range(200)]
    rows = [(i, " ".join(common[:100] + [word() for _ in range(75)] + common[100:])) for i in range(1, 31)] + [(i, " ".join([word() for _ in range(75)] + common)) for i in range(31, 61)]
    rows += [(900, " ".join(common)), (901, " ".join([*common[:90], "other", *common[91:]]))]
    got = {r["doc_id"]: r["class_id"] for r in op6.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows) and got[901] == got[900] == 900


def test_many_short_heads_hide_no_link(spark):
    rng = random.Random(61)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    rows = [(100 + o, " ".join(base[:o] + base[o + 30 :])) for o in range(0, 91, 2)]  # each near some others, none near the whole
    rows += [(i, " ".join([*base[: 58 + i], f"own{i}", *base[59 + i :]])) for i in range(1, 5)]
    got = {r["doc_id"]: r["class_id"] for r in op6.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows) and {got[i] for i in range(1, 5)} == {1} and got[100] != 1
