"""Integer vectors in shards of bounded size, and exact arithmetic on them.

A component x becomes floor(256 x), held within +-2^62. Shards are cells of median splits, fitted on a
bounded sample of the rows of the commonest length, and each cell is divided by a hash until no shard has
many more than the size asked for; so neither a dense region nor copies of one vector make a large shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
HELD = 2**62
#: rows, on average, that the splits of the cells are fitted on, and most cells
SAMPLE = 16_384
CELLS = 256
LONG = (-(2**63), 2**63 - 1)


def finite(vector: str) -> Column:
    """Not null and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def pack(x: np.ndarray) -> bytes:
    """Integers of any shape in the narrowest of 2, 4 and 8 bytes, which the first byte names."""
    most = int(max(x.max(initial=0), -int(x.min(initial=0))))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(packed: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)
    return flat.reshape(-1, columns) if columns else flat.reshape(0, 0)


def matrix(packed: pd.Series, columns: int) -> np.ndarray:
    """The rows of a column of packed vectors of one length."""
    if len({p[0] for p in packed}) == 1 and columns:
        return np.frombuffer(b"".join(p[1:] for p in packed), f"<i{packed.iloc[0][0]}").reshape(-1, columns).astype(np.int64)
    return np.stack([unpack(p, columns)[0] for p in packed]) if columns else np.zeros((len(packed), 0), np.int64)


def largest(*parts: np.ndarray) -> int:
    return max([max(int(p.max(initial=0)), -int(p.min(initial=0))) for p in parts])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of x, exact, held within the range of long."""
    bound = largest(q) * largest(x) * max(1, x.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, *LONG).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact (Python integers where 8 bytes are too few)."""
    bound = 4 * largest(x, c) ** 2 * max(1, x.shape[1])
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    x, c = x.astype(kind), c.astype(kind)
    out = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    return out if kind is object else out.astype(np.int64)


def integer_rows(vectors: DataFrame, vector: str, **columns: Column) -> DataFrame:
    """``uid, size, vec`` and the named columns of rows with finite vectors, written once; uid tells rows apart."""
    names = list(columns)
    plain = vectors.where(finite(vector)).select(F.monotonically_increasing_id().alias("uid"), *[c.alias(n) for n, c in columns.items()], F.col(vector).cast("array<double>").alias("v"))
    kept = f"uid long, {''.join(f'{n} {plain.schema[n].dataType.simpleString()}, ' for n in names)}size int, vec binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            whole = [np.clip(np.floor(SCALE * np.asarray(v, np.float64)), -HELD, HELD).astype(np.int64) for v in d["v"]]
            yield d[["uid", *names]].assign(size=np.array([len(v) for v in whole], np.int32), vec=[pack(v) for v in whole])

    return stored(plain.mapInPandas(run, kept), "vectors")


def splits(x: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """Median splits of a sample on its widest component: (component, value, lower, higher) by node.

    A lower or higher of -1 - c is cell c; other numbers are nodes.
    """
    nodes: list[tuple[int, int, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal made
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(0)
        if parts < 2 or not spread.any():
            made += 1
            return -made
        c = int(spread.argmax())
        value = int(np.partition(rows[:, c], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
        if value == rows[:, c].max():
            value -= 1  # the higher side is not empty
        me = len(nodes)
        nodes.append((c, value, 0, 0))
        low = grow(rows[rows[:, c] <= value], parts // 2)
        nodes[me] = (c, value, low, grow(rows[rows[:, c] > value], parts - parts // 2))
        return me

    grow(x, cells)
    return nodes


def cell_of(x: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    if not nodes:
        return at
    c, value, low, high = (np.array(a, np.int64) for a in zip(*nodes))
    while (inside := at >= 0).any():
        rows, n = np.flatnonzero(inside), at[inside]
        at[rows] = np.where(x[rows, c[n]] <= value[n], low[n], high[n])
    return -1 - at


def sharded(rows: DataFrame, per_shard: int) -> DataFrame:
    """``rows`` with a column shard: near vectors of one length, about ``per_shard`` rows at most."""
    common = rows.groupBy("size").count().orderBy(F.col("count").desc(), "size").limit(1).collect()
    size, n = (common[0]["size"], common[0]["count"]) if common else (0, 0)
    nodes = []
    if size and n > per_shard:
        every = max(1, n // SAMPLE)
        sample = rows.where((F.col("size") == size) & (F.pmod(F.xxhash64("uid"), F.lit(every)) == 0)).select("vec").toPandas()
        if len(sample):
            nodes = splits(matrix(sample["vec"], size), min(CELLS, -(-n // per_shard)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            cell = np.zeros(len(d), np.int64)
            own = (d["size"] == size).to_numpy()
            if nodes and own.any():
                cell[own] = cell_of(matrix(d["vec"][own], size), nodes)
            yield d.assign(cell=cell)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    coded = rows.mapInPandas(route, f"{fields}, cell long")
    parts = coded.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / per_shard).alias("parts"))
    shard = F.concat_ws("-", "size", "cell", F.pmod(F.xxhash64(F.lit(7), "uid"), F.col("parts")))
    return coded.join(parts, ["size", "cell"]).withColumn("shard", shard).drop("cell", "parts")
