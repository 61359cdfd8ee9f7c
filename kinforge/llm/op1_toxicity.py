"""Toxicity by weak supervision.

Voters are words and word beginnings (patterns ``stem*``) that either stand in a fixed lexicon or
stand out in the labelled training rows, disguised spellings of them, and patterns of shouting.
Each votes toxic where it fires; the absence of every lexical voter votes clean. A generative
label model sees labelled and unlabelled rows alike: expectation maximisation estimates how often
each voter fires in either class, and from the posteriors how far voters fire together beyond
that; correlated voters share their evidence. A gold label is one more voter, which abstains on
unlabelled rows and whose rates are estimated like the others'. The unlabelled rows together weigh
a twentieth of the labelled ones, so that they refine the classes but cannot shift them. The posteriors of all these rows train a linear (logistic)
classifier on word and beginning features, which scores every whole text.

The fit sees at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, those with the smallest seeded
hashes, and about ``UNLABELLED`` other rows, those whose seeded hash lies below the share that
gives so many. Rows whose crc32(doc_id as text) mod 5 is 0 are held out of both. Labels, lang,
source and doc_id are never features.

Defined cases: null and empty texts have no feature and get the score of the intercept; a table
without usable labels is scored by the fixed lexicon alone; repeated rows are scored one by one
and one row of an id is learned from; an empty table gives no rows; ``score`` replaces input
columns named score or predicted, other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_null, small_batches, table

MAX_TOXIC = 4_000
MAX_CLEAN = 8_000
MAX_FEATURES = 6_000
MAX_VOTERS = 160
SEED = 1789
UNLABELLED = 4_000
#: what all unlabelled rows weigh together, against the labelled ones
UNLABELLED_SHARE = 0.05
#: how often gold labels are right, to begin with
GOLD_START = 0.95

#: fixed values: common English insults
LEXICON = (
    "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool imbecile jerk garbage "
    "filth vermin freak creep coward liar pig rat swine parasite degenerate disgrace ugly lunatic cretin dunce twit"
).split()
#: fixed values: signs that stand for letters in disguised spellings
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

TOKEN = re.compile(r"[^\W_]+")
MIXED = re.compile(r"(?=[\w@$!]*[0-9@$!])(?=[\w@$!]*[a-z])[\w@$!]{3,30}")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
STEMS = (4, 5, 6)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def expand(word: str) -> list[str]:
    """The features of one word: itself and its beginnings."""
    return [word[:40], *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def marks(text: str, lower: str) -> list[str]:
    """Patterns that no single word shows: disguised spellings and shouting."""
    found = [f"~{m.group().translate(DISGUISE)[:40]}" for m in MIXED.finditer(lower)] if re.search("[0-9@$!]", lower) else []
    if len(SHOUT.findall(text)) >= 3:
        found.append("#shout")
    if "!!!" in text:
        found.append("#exclaim")
    return found


def features(text: str) -> set[str]:
    lower = text.lower()
    out = set(marks(text, lower))
    for w in set(TOKEN.findall(lower)):
        out.update(expand(w))
    return out


@dataclass
class Model:
    """Feature weights of the classifier; ``voters`` and ``posteriors`` are kept for inspection."""

    weights: dict[str, float]
    bias: float
    voters: list[str]

    def scorer(self):
        own = self.weights
        ids = {f: i for i, f in enumerate(own)}
        value = list(own.values())
        bias = self.bias

        class Known(dict):
            def __missing__(self, word):
                found = self[word] = tuple(ids[f] for f in expand(word) if f in ids)
                return found

        known = Known()

        def score(text: str) -> float:
            lower = text.lower()
            if len(known) > 250_000:
                known.clear()
            hit: set[int] = set()
            for found in map(known.__getitem__, set(TOKEN.findall(lower))):
                if found:
                    hit.update(found)
            hit.update(ids[m] for m in marks(text, lower) if m in ids)
            z = bias + sum(value[i] for i in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def label_model(fires: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Posteriors P(toxic), each voter's share of its evidence, and the gold voter's rates P(1 | toxic) and P(1 | clean).

    ``fires`` is rows x voters, ``gold`` 1, 0 or -1 where there is no label. Each voter fires at a
    rate of its own in either class; expectation maximisation begins at the labelled rows alone.
    The prior is that of the labelled rows.
    Correlations within the classes are estimated from the residuals, and a voter's log ratio is
    divided by one plus the sum of its positive correlations over 0.2.
    """
    n, k = fires.shape
    known = gold >= 0
    weight = np.where(known, 1.0, min(1.0, UNLABELLED_SHARE * known.sum() / max(1, (~known).sum())))
    post = np.where(gold == 1, GOLD_START, 1 - GOLD_START)
    share = np.ones(k)
    x = fires.astype(np.float32)  # at most some 16,000 rows of 321 voters: 21 MB on the driver
    hit, miss = GOLD_START, 1 - GOLD_START
    for step in range(rounds):
        w = weight * (known if step == 0 else 1)
        one, zero = w * post, w * (1 - post)
        a, b = (x.T @ one + 0.5) / (one.sum() + 1), (x.T @ zero + 0.5) / (zero.sum() + 1)
        if step:
            hit = float(np.clip((post[gold == 1].sum() + 1) / (post[known].sum() + 2), 0.6, 0.999))
            miss = float(np.clip(((1 - post)[gold == 1].sum() + 1) / ((1 - post)[known].sum() + 2), 0.001, 0.4))
        prior = np.log((post[known].sum() + 1) / ((1 - post)[known].sum() + 1))
        on, off = share * np.log(a / b), share * np.log((1 - a) / (1 - b))
        z = prior + x @ (on - off) + off.sum()
        z = z + np.where(gold == 1, np.log(hit / miss), 0) + np.where(gold == 0, np.log((1 - hit) / (1 - miss)), 0)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if step == rounds // 2:
            # residuals are x less a sum of two products, so their products need no matrix of their size
            root = np.sqrt(weight).astype(np.float32)
            own, mean = x * root[:, None], np.stack([post, 1 - post], axis=1) * root[:, None]
            rates = np.stack([a, b])
            cross = (own.T @ mean) @ rates
            product = own.T @ own - cross - cross.T + rates.T @ (mean.T @ mean) @ rates
            sd = np.sqrt(np.maximum(np.diag(product), 0) / n) + 1e-6
            corr = product / n / sd[:, None] / sd[None, :]
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
    return post, share, (hit, miss)


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, k: int, target: np.ndarray, row_weight: np.ndarray | None = None, penalty: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept for binary features given as (row, column) pairs and soft targets; classes weigh the same."""
    w, b = np.zeros(k), 0.0
    own = np.ones(n) if row_weight is None else row_weight * n / row_weight.sum()
    positive = max((own * target).sum(), 1e-9)
    weight = own * np.clip(np.where(target > 0.5, 0.5 * n / positive, 0.5 * n / max(n - positive, 1e-9)), 0, 20)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(cols, e[rows], k) + penalty * w / n * 10, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def default_model() -> Model:
    return Model({w: 6.0 for w in LEXICON} | {f"~{w}": 6.0 for w in LEXICON}, -4.0, list(LEXICON))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """At most MAX_TOXIC + MAX_CLEAN labelled and about UNLABELLED other rows (text, toxic or -1) outside the held-out fold."""
    own = F.col(key)
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(own) & own.isNotNull())
    l = usable.groupBy(own.alias("_key")).agg(F.max("toxic").alias("_toxic")).withColumn("_order", F.xxhash64(F.lit(SEED), "_key"))
    take = [l.where(F.col("_toxic") == y).orderBy("_order").limit(most).select("_key", "_toxic") for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = take[0].unionByName(take[1])
    d = docs.select(own.alias("_key"), no_null(text).alias("text"))
    # at most MAX_TOXIC + MAX_CLEAN rows of two numbers, so the side has a proven bound
    known = d.join(F.broadcast(chosen), "_key").select("_key", "text", F.col("_toxic").alias("toxic"))
    grain = 1 << 30
    below = min(grain, grain * UNLABELLED // max(1, docs.count()))
    drawn = d.where(own_hash("_key", grain) < below).where(F.col("_key").isNotNull() & ~held_out(F.col("_key"))).select("_key", "text", F.lit(-1).alias("toxic"))
    rows = known.unionByName(drawn).groupBy("_key").agg(F.max_by(F.struct("text", "toxic"), "toxic").alias("r"))
    return rows.select("r.text", "r.toxic")


def own_hash(key: str, grain: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), key), F.lit(grain))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, key, text)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"f": [sorted(features(t)) for t in d["text"]], "toxic": d["toxic"].astype("int32")})

    spread_rows = rows.mapInPandas(spread, "f array<string>, toxic int").persist()
    try:
        totals = {r["toxic"]: r["n"] for r in spread_rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not totals.get(1) or not totals.get(0):
            return default_model()
        n1, n0 = totals[1], totals[0]
        gold_rows = spread_rows.where("toxic >= 0").select("toxic", F.explode("f").alias("f"))
        counts = gold_rows.groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
        # the features that tell the classes apart best: a bounded list for the driver
        ranked = counts.where(F.col("a") + F.col("b") >= 3).withColumn("r", ratio).withColumn("s", F.abs("r") * F.sqrt(F.greatest(F.col("a") / n1, F.col("b") / n0)))
        best = ranked.orderBy(F.col("s").desc(), "f").limit(MAX_FEATURES).collect()
        fixed = {*LEXICON, *(f"~{w}" for w in LEXICON)}
        vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*(r["f"] for r in best), *sorted(fixed)]))}
        strong = [r["f"] for r in best if r["a"] >= 3 and r["r"] > 2.5][:MAX_VOTERS]
        voters = list(dict.fromkeys([*strong, *(f for f in vocabulary if f in fixed or f[0] in "~#")]))[: 2 * MAX_VOTERS]

        def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                yield pd.DataFrame({"f": [sorted(vocabulary[x] for x in f if x in vocabulary) for f in d["f"]], "toxic": d["toxic"]})

        sample = spread_rows.mapInPandas(index, "f array<int>, toxic int").toPandas()
    finally:
        spread_rows.unpersist()
    return learned(list(sample["f"]), sample["toxic"].to_numpy(), vocabulary, voters)


def learned(found: list[np.ndarray], gold: np.ndarray, vocabulary: dict[str, int], voters: list[str]) -> Model:
    """The classifier from the rows' feature numbers and labels (-1: none)."""
    order = sorted(range(len(found)), key=lambda i: (int(gold[i]), np.asarray(found[i], ">i4").tobytes()))
    gold = np.asarray(gold)[order].astype(int)
    lists = [np.asarray(found[i], np.int32) for i in order]
    r = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    c = np.concatenate([*lists, np.zeros(0, np.int32)])
    n, k = len(lists), len(vocabulary)
    column = np.full(k, -1)
    for j, f in enumerate(voters):
        column[vocabulary[f]] = j
    fires = np.zeros((n, len(voters) + 1), bool)
    on = column[c] >= 0
    fires[r[on], column[c[on]]] = True
    lexical = [j for j, f in enumerate(voters) if f[0] != "#"]
    fires[:, -1] = ~fires[:, lexical].any(axis=1)  # the voter for clean texts
    post, _, _ = label_model(fires, gold)
    weight = np.where(gold >= 0, 1.0, min(1.0, UNLABELLED_SHARE * (gold >= 0).sum() / max(1, (gold < 0).sum())))
    w, b = logistic(r, c, n, k, post, weight)
    weights = {f: round(float(w[i]), 6) for f, i in vocabulary.items() if abs(w[i]) > 1e-4}
    return Model(weights, round(b, 6), voters)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` in [0, 1] and ``predicted``."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield texts.map(one).astype("float64")

    return docs.withColumn("score", rate(no_null(text))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
