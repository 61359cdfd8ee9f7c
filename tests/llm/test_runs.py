import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinforge.llm import op12_runs as op12


def plain_runs(words):
    """Every maximal stretch by trying all periods at all places."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # periods rise, so the first is the smallest
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_and_repeated_words(letters):
    rng = random.Random(letters)
    for turn in range(250):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
        for _ in range(turn % 4):  # repeat some stretch a few times, not always wholly
            i, m = rng.randrange(len(words) + 1), rng.randrange(1, 20)
            words[i:i] = (words[i : i + m] * 5)[: rng.randrange(1, 5 * m)]
        assert op12.runs(np.array(words, np.int64)).tolist() == [list(r) for r in plain_runs(words)]


def test_blocks_of_candidates_do_not_matter(monkeypatch):
    rng = random.Random(8)
    words = np.array([rng.randrange(3) for _ in range(400)] + [1, 2, 0, 2] * 40 + [5, 5, 1] * 9 + [4] * 50)
    whole = op12.runs(words).tolist()
    monkeypatch.setattr(op12, "STEP", 7)
    monkeypatch.setattr(op12, "LONG", 0)
    assert op12.runs(words).tolist() == whole == [list(r) for r in plain_runs(words.tolist())]


def test_table_against_the_plain_program(spark):
    rng = random.Random(3)
    rows = [(i, " \t\n\x0b\x0c\r"[i % 6].join(rng.choice("abé") for _ in range(rng.randrange(0, 70)))) for i in range(400)]
    rows += [(None, "x " * 40), (7, None), (7, ""), (7, " \n "), (9, "a a " * 15), (9, "a a " * 15)]
    d = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start long, n_runs string")
    got = sorted(map(tuple, op12.periodic_runs(d).collect()), key=str)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    assert got == sorted((plain_row(*r) for r in rows), key=str)


def test_very_long_texts(spark):
    long = spark.createDataFrame([(None, "w " * 1_000_000 + "v w")], "doc_id long, text string")
    assert [tuple(r)[1:6] for r in op12.periodic_runs(long).collect()] == [(1, 0, 1_000_000, 1, 1_000_000_000)]

    text = " ".join(f"w{i % 1009}" for i in range(300_000))
    n, start, length, period, milli, _, rest = op12.digest(text, None)
    assert (n, start, length, period, milli) == (1, 0, 300_000, 1009, 297_324)
    assert rest == hashlib.sha256(" ".join(f"w{i}" for i in range(1009)).encode()).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12.periodic_runs(empty).count() == 0


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r[0]: tuple(r) for r in op12.op12_periodic_runs(spark, sf).collect()}
    assert got.keys() == rows.keys()
    short = [k for k in rows if len((rows[k] or "").split()) < 1500]
    assert all(got[k] == plain_row(k, rows[k]) for k in short)
