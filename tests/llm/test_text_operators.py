import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinforge.llm import op1_toxicity as op1
from kinforge.llm import op2_tokens as op2
from kinforge.llm import op4_packing as op4
from kinforge.llm import op6_near_dedup as op6
from kinforge.llm import op7_lines as op7

DOC = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], DOC)


# -- toxicity
def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(words, k=40)) + (f" {rng.choice(['idiot', 'grubelnak', 'grubelort'])}" if toxic else "")))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    d = docs(spark, rows)
    model = op1.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    from pyspark.sql import functions as F

    out = {r["doc_id"]: r for r in op1.score(d, model).withColumn("h", op1.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(600) if out[i]["h"]]
    assert held and np.mean([out[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert out[1000]["score"] == out[1001]["score"] and out[1000]["predicted"] == 0


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "you idiot"), (2, "good day")])
    model = op1.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in op1.score(d, model).orderBy("doc_id").collect()] == [1, 0]


# -- tokens
def test_token_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, machine = Tokenizer.from_file(path), op2.Transducer(path)
    rng = random.Random(2)
    signs = "abcdefgh ijklmnop' .,!s'tre12é日\nΣ  İ"
    cases = ["", "don't 've 'rex ''s", "aaaa" * 50, "<|endoftext|>x<|startoftext|>", "ΣΟΦΟΣ ½ ²", "a\x1cb\x85c"] + ["".join(rng.choices(signs, k=rng.randint(1, 90))) for _ in range(400)]
    for c in cases:
        assert machine.count(c) == machine.count(c, 7) == len(lib.encode(c, add_special_tokens=False).ids)


def test_token_query_columns(spark):
    r = op2.count_tokens(docs(spark, [(1, None), (2, ""), (3, "é b")])).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in r] == [(0, 0, False), (0, 0, False), (4, 2, False)]


# -- packing
def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(0, 50) for _ in range(rng.randint(0, 60))]
        plain = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            room = [(50 - sum(lengths[j] for j in r), k) for k, r in enumerate(plain)]
            fits = [x for x in room if x[0] >= lengths[i]]
            if fits:
                plain[min(fits)[1]].append(i)
            else:
                plain.append([i])
        rows = op4.best_fit_decreasing(lengths, 50)
        assert len(rows) == len(plain) and sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= 50 for r in rows)


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["alpha", "béta", "gamma\n", "", "日本"], k=rng.randint(0, 3000 if i == 5 else 200)))) for i in range(40)] + [(40, None), (41, ""), (7, "again")]
    rows = op4.pack(docs(spark, texts).coalesce(1)).collect()
    back, encode = op4.unpack(rows), op4.encoder()
    assert len(back) == len(texts)
    for k, (i, t) in enumerate(texts):
        assert encode.decode(back[k, i]) == (t or "")
    assert all(len(r["input_ids"]) == 2 * op4.WIDTH and r["cu_seqlens"][-1] == r["n_tokens"] for r in rows)


def test_packing_nothing(spark):
    assert op4.pack(docs(spark, [])).count() == 0


# -- near duplicates
def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    rows = []
    for b in base:
        for copy in range(4):
            w = list(b)
            for _ in range(copy):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, ""), (104, "one two"), (105, "one two")]
    got = {r["doc_id"]: r["class_id"] for r in op6.near_classes(docs(spark, rows)).collect()}
    h = {i: op6.labelled(op6.word_hashes(t or "")) for i, t in rows}
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i in h:
            for j in h:
                if i < j and (op6.similarity(h[i], h[j]) >= op6.SIMILAR) and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = {k: a if v == b else v for k, v in label.items()}
        break
    assert got == label
    kept = [r["doc_id"] for r in op6.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(label.values()))


# -- lines
def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    lines = []
    for _ in range(25):
        a = [rng.choice(words) for _ in range(10)]
        lines.append(a)
        b = list(a)
        b[rng.randrange(10)] = "changed"
        lines += [b, a[:4] + a[5:], a[:3] + ["new"] + a[3:]] + [["x", rng.choice(words)]]
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(x) for x in lines[5 * i : 5 * i + 5])) for i in range(25)] + [(30, None), (31, "\n\n"), (32, "x w1")]
    flat = [((i, n), t.lower().split()) for i, text in rows for n, t in enumerate((text or "").split("\n")) if t.split()]
    want = set()
    for k, (at, w) in enumerate(flat):
        for _, v in flat[:k]:
            if v == w or (min(len(v), len(w)) >= op7.MIN_WORDS and op7.within_one(v, w)):
                want.add(at)
    assert {(r["doc_id"], r["line_no"]) for r in op7.removals(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("a,b,near", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b", "a b c", True), ("a b", "b a", False), ("a", "a b c", False)])
def test_within_one(a, b, near):
    assert op7.within_one(a.split(), b.split()) is near
