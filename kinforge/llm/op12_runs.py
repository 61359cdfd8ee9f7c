"""Runs of repeated word sequences, found by power-of-two naming.

Level 0 of the naming numbers the words; level k + 1 numbers the pairs of equal-length halves, so two
stretches of 2^k words are equal exactly if their names are. How far two positions agree, to the right
or to the left, is read off by going down the levels. A run with period q and at least
``max(LEAST, 2 q)`` words covers a point of the grid with steps of ``max(q, LEAST - q)`` for which the
word q places on is equal; such points are the candidates, n log n of them at most, and each is extended
both ways. A stretch found with several periods is kept with the smallest. Levels are built only as far
as some candidate needs them. A document is worked on alone, in a batch of an Arrow map; nothing is
shuffled.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text's UTF-8. Some documents are made periodic first
(``planted``), by the checksum of their id.

Defined cases: a null or empty text, or one without words, has no runs, four nulls, and the digests of
an empty string; a null doc_id is kept and its text is taken as it is; repeated rows give repeated rows;
an empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored, table

#: fewest words of a run
LEAST = 12
#: candidates looked at in one step
STEP = 1 << 18
#: texts of more words than this give more than one block of candidates, which later blocks can gain from
LONG = 20_000
#: documents in one Arrow batch
BATCH = 500
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """Names of all stretches of 1, 2, 4, ... words; ``level[k][i]`` names the 2^k words from i."""

    def __init__(self, words: np.ndarray):
        self.level = [words.astype(np.int64)]

    def grow(self) -> bool:
        """One level more; false if no stretch is that long."""
        half, last = 1 << (len(self.level) - 1), self.level[-1]
        if len(last) <= half:
            return False
        left, right = last[:-half], last[half:]
        self.level.append(np.unique(left * (int(last.max()) + 1) + right, return_inverse=True)[1].astype(np.int64))
        return True

    def same(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where the 2^k words from i and from j > i lie in the text and are equal."""
        names = self.level[k]
        inside = (i >= 0) & (j < len(names))
        return inside & (names[np.where(inside, i, 0)] == names[np.where(inside, j, 0)])

    def cover(self, i: np.ndarray, j: np.ndarray) -> None:
        """Build levels until none of the pairs agrees on a whole stretch of the top level, on either side."""
        right = left = np.arange(len(i))
        while len(right) or len(left):
            k = len(self.level) - 1
            right = right[self.same(k, i[right], j[right])]
            left = left[self.same(k, i[left] - (1 << k), j[left] - (1 << k))]
            if not (len(right) or len(left)) or not self.grow():
                return

    def extent(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """Words that agree from i and j on (right), or before them."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            at = out if right else -out - (1 << k)
            out += self.same(k, i + at, j + at).astype(np.int64) << k
        return out


def grid(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, period) of grid points whose word comes again a period later, in blocks of bounded size."""
    n = len(words)
    if n < LEAST:
        return
    periods = np.arange(1, n // 2 + 1, dtype=np.int64)
    steps = np.maximum(periods, LEAST - periods)
    counts = -(-(n - periods) // steps)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(periods):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        c = counts[lo:hi]
        q = np.repeat(periods[lo:hi], c)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(steps[lo:hi], c)
        hit = words[i] == words[i + q]
        yield i[hit], q[hit]
        lo = hi


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a numbered text, by start, then period."""
    names, found = Names(words), [np.zeros((0, 3), np.int64)]
    end, base = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)  # of a run entered here
    for i, q in grid(words):
        old = (i + q < end[i]) & (q % base[i] == 0)  # the stretch of a multiple is that of the period itself
        i, q = i[~old], q[~old]
        names.cover(i, i + q)
        before, after = names.extent(i, i + q, False), names.extent(i, i + q, True)
        fits = before + after >= np.maximum(q, LEAST - q)
        rows = np.stack([i - before, before + after + q, q], axis=1)[fits]
        found.append(np.unique(rows, axis=0))
        if len(words) > LONG:
            for s, length, p in found[-1][np.argsort(found[-1][:, 2], kind="stable")].tolist():
                if s + length > end[s]:
                    end[s : s + length], base[s : s + length] = s + length, p
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(n: int, checksum: int | None) -> np.ndarray:
    """For each place the original word that stands there: some documents are made periodic from a place on."""
    at = np.arange(n, dtype=np.int64)
    if checksum is None or checksum % 10 or not n:
        return at
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The text with every run cut to its first period."""
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(marks[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def digest(text: str | None, checksum: int | None) -> tuple:
    """The columns of a document after its doc_id."""
    words = (text or "").encode().split()
    place = planted(len(words), checksum)
    number: dict[bytes, int] = {}
    found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64)[place])
    best: tuple = (None,) * 4
    if len(found):
        s, length, q = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found.tolist())
    rest = collapsed([words[i] for i in place], found)
    return len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: number of runs, the longest run, digests of all runs and of the collapsed text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(k if pd.notna(k) else None, *digest(t, int(h) if pd.notna(h) else None)) for k, t, h in zip(d["k"], d["t"], d["h"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({c: "Int64" for c in out.columns if not c.endswith("sha256")})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    with batches_of(docs.sparkSession, BATCH):
        return stored(rows.mapInPandas(work, SCHEMA), "runs")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
