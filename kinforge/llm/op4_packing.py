"""Token ids packed into rows of fixed width by best-fit decreasing.

Each scan task reads its texts in turn, encodes them with a byte-level vocabulary, and packs a
window of them at a time: documents longer than a row are cut without loss into full rows and a
rest, and rests and short documents go, longest first, into the open row with the least capacity
that still holds them. A segment tree over capacities finds that row. Nothing is shuffled, and a
window holds a bounded number of tokens and documents, or one document.

A packed row has its ids as little-endian unsigned integers, padded with the pad id to the width;
``cu_seqlens`` are the segments' borders from 0; ``doc_ids``, ``starts`` and ``occurrences`` tell
for each segment its document, its first token's place in the document (the position at which its
positions restart) and which of the window's rows it came from, so that ``unpack`` restores every
document's ids.

Defined cases: null and empty texts have no ids and take a segment of length 0; repeated rows are
packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

WIDTH = 2048
PAD = 50256
WINDOW_TOKENS = 1 << 22
WINDOW_DOCS = 4096
KEEP = 400_000
SCHEMA = "bin_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, occurrences array<int>"
ARROW = pa.schema([("bin_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int32()))])


class Encoder:
    """Bytes of uint16 ids of a text; pieces that begin at a single space are encoded once and kept."""

    def __init__(self, path: str | None, vocabulary: str):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(self)

    def direct(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(self.pieces) > KEEP:
            self.pieces = Pieces(self)
        parts = text.split(" ")
        # a space between two signs that are not space always begins a piece of the word pattern
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self.direct(text)
        return self.direct(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode(np.frombuffer(ids, "<u2").tolist())


class Pieces(dict):
    def __init__(self, encoder: Encoder):
        self.direct = encoder.direct

    def __missing__(self, piece: str) -> bytes:
        ids = self.direct(" " + piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken") -> Encoder:
    return Encoder(path, vocabulary)


class Capacities:
    """Segment tree over the capacities 0..width: each node counts the open rows below it."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of least capacity >= need, and that capacity; it is no longer open."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up to the first ancestor with rows to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: list[int], width: int = WIDTH) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each at most ``width``); every index is in one row."""
    rows: list[list[int]] = []
    open_rows = Capacities(width)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        row, capacity = found or (len(rows), width)
        if not found:
            rows.append([])
        rows[row].append(i)
        open_rows.put(capacity - lengths[i], row)
    return rows


def pack_window(docs: list[tuple[int | None, bytes]], width: int, pad: int) -> Iterator[tuple]:
    """Rows (n_tokens, ids, cu_seqlens, doc_ids, starts, occurrences) for (id, ids) pairs."""
    pieces: list[tuple[int, int, int]] = []  # document, first token, length
    for k, (_, ids) in enumerate(docs):
        n = len(ids) // 2
        pieces += [(k, s, min(width, n - s)) for s in range(0, max(n, 1), width)]
    for row in best_fit_decreasing([p[2] for p in pieces], width):
        own = [pieces[i] for i in row]
        ids = b"".join(docs[k][1][2 * s : 2 * (s + n)] for k, s, n in own)
        total = len(ids) // 2
        borders = np.concatenate([[0], np.cumsum([n for _, _, n in own])]).astype(np.int32)
        yield total, ids + pad.to_bytes(2, "little") * (width - total), borders, [docs[k][0] for k, _, _ in own], [s for _, s, _ in own], [k for k, _, _ in own]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, pad: int = PAD, path: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", window_tokens: int = WINDOW_TOKENS, window_docs: int = WINDOW_DOCS) -> DataFrame:
    """One row for each packed row; see the module's text for its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, vocabulary)
        base, made = TaskContext.get().partitionId() << 40, 0
        window: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = list(pack_window(window, width, pad))
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                columns = [[base + made + j for j in range(len(part))], *map(list, zip(*part))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)
                made += len(part)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py() or "")
                window.append((doc, ids))
                tokens += len(ids) // 2
                if tokens >= window_tokens or len(window) >= window_docs:
                    yield from flush()
                    window, tokens = [], 0
        if window:
            yield from flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


def unpack(rows: list) -> dict[tuple, bytes]:
    """(window row, document) -> ids, for the rows of one window: the exact inverse of packing."""
    found: dict[tuple, list[tuple[int, bytes]]] = {}
    for r in rows:
        for i, (doc, start, k) in enumerate(zip(r["doc_ids"], r["starts"], r["occurrences"])):
            a, b = r["cu_seqlens"][i], r["cu_seqlens"][i + 1]
            found.setdefault((k, doc), []).append((start, bytes(r["input_ids"])[2 * a : 2 * b]))
    return {k: b"".join(x for _, x in sorted(v)) for k, v in found.items()}


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
