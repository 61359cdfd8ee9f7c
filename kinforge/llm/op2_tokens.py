"""Token counts from a compiled finite-state transducer.

The tokenizer file is a byte-pair vocabulary with word ends. Two facts make it a deterministic
transducer. The tokens of a prefix of a word depend only on the last token at each earlier place,
and a token can follow another exactly if no merge crosses their border. So the state after some
letters is the longest suffix that still begins a token together with the last token and the
relative number of tokens at each place inside it; a transition's output is the change in the
number of tokens. The word pattern (letters, single digits, runs of other signs, contractions) is
a small automaton over character classes whose states carry that state. Transitions are compiled
when they are first needed and kept, within a bound, for the life of the worker.

Every text is cut into chunks. A chunk's state map takes any state in which it may be entered to
the state after it and the tokens between. White space leads every state to the start, so the map
is three parts: the letters before the first space, which run from the entering state, the number
of tokens that are complete behind them, and the number of the state that the letters after the
last space reach. Two maps compose by running the second's first letters from the first's last
state; a parallel prefix scan composes them all, from the start state on. The transitions of whole
units between spaces are kept composed, as is the state that a unit reaches.

Defined cases: null and empty texts have 0 tokens and 0 bytes; the strings of special tokens
inside a text count one each, as the library has it; repeated rows are counted one by one; an
empty table gives no rows; input columns named n_bytes, n_tokens or over_limit are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_null, small_batches, table

CHUNK = 1 << 12
LIMIT = 2048
KEEP_UNITS = 300_000
KEEP_STEPS = 500_000
NEVER = 1 << 60
END = 0xE000  # symbols of bytes that end a word: private code points from here on

SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = re.compile(f"[{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
LETTER, NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [at[b] for b in range(256)]


class Merges:
    """The vocabulary as merge trees: what is a token, and which tokens can stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or "</w>"
        self.special = [t["content"] for t in spec["added_tokens"]]
        stand = byte_symbols()
        last = {s: chr(END + b) for b, s in enumerate(stand)}

        def symbols(token: str) -> str:
            return token[: -len(suffix) - 1] + last[token[-len(suffix) - 1]] if token.endswith(suffix) else token

        self.stand, self.last = stand, last
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[symbols(a), symbols(b)] = i
        self.tokens = {symbols(t) for t in model["vocab"] if t != suffix}
        self.starts = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        self.trees: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def spines(self, token: str) -> tuple[list, list] | None:
        """Nodes down the left and right edge, leaf first, each with the rank at which it goes into its parent; None if merging the symbols does not give the token."""
        if token not in self.trees:
            parts: list[tuple] = [(c, None, None, -1) for c in token]
            while len(parts) > 1:
                ranks = [self.rank.get((a[0], b[0]), NEVER) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == NEVER:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1], best)]
            found = None
            if len(parts) == 1 and token in self.tokens:
                found = []
                for side in (1, 2):
                    node, up, line = parts[0], NEVER, []
                    while node is not None:
                        line.append((node[0], up))
                        up, node = node[3], node[side]
                    found.append(line[::-1])
                found = tuple(found)
            self.trees[token] = found
        return self.trees[token]

    def fit(self, a: str, b: str) -> bool:
        """Whether token a can stand before token b: no merge crosses the border while both are built."""
        known = self.pairs.get((a, b))
        if known is None:
            right, left = self.spines(a)[1], self.spines(b)[0]
            i = j = 0
            known = True
            while True:
                (x, px), (y, py) = right[i], left[j]
                m = self.rank.get((x, y), NEVER)
                if m < px and m <= py and m != NEVER:
                    known = False
                    break
                if px == NEVER and py == NEVER:
                    break
                if px <= py:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > KEEP_STEPS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known


class Transducer:
    """Reads characters; state 0 is the start. Steps and closings are compiled when first used."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {("none",): 0}
        self.states: list[tuple] = [("none",)]
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.closed: dict[int, int] = {0: 0}
        self.units, self.reached = Units(self), Reached(self)
        self.words: list[tuple] = [("", ("",), (0,))]
        self.word_ids: dict[tuple, int] = {self.words[0]: 0}
        self.fed: dict[tuple[int, str], tuple[int, int]] = {}

    # -- symbols of one word: state is (suffix, last tokens at its places, counts relative to its end)
    def feed(self, q: int, x: str) -> tuple[int, int]:
        move = self.fed.get((q, x))
        if move is None:
            state, gain = self.compile(self.words[q], x)
            to = self.word_ids.get(state)
            if to is None:
                to = self.word_ids[state] = len(self.words)
                self.words.append(state)
            move = self.fed[q, x] = (to, gain)
        return move

    def compile(self, q: tuple, x: str) -> tuple[tuple, int]:
        suffix, lasts, counts = q
        text = suffix + x
        for n in range(len(text), 0, -1):  # the longest token that can follow what is before it
            t = text[-n:]
            if t in self.merges.tokens and self.merges.spines(t):
                before = lasts[len(suffix) - n + 1]
                if before == "" or (before is not None and self.merges.fit(before, t)):
                    break
        else:
            raise ValueError(f"no token ends with {x!r}")
        gain = counts[len(suffix) - n + 1] + 1
        lasts, counts = (*lasts, t), (*(c - gain for c in counts), 0)
        starts = self.merges.starts
        live = [text[i:] in starts for i in range(len(text))]  # places where a longer token may begin
        at = live.index(True) if True in live else len(text)
        live = [*live[at:], True]
        lasts = tuple(t if on else None for t, on in zip(lasts[at:], live))
        return (text[at:], lasts, tuple(c if on else 0 for c, on in zip(counts[at:], live))), gain

    def letter(self, run: tuple | None, c: str) -> tuple[tuple, int]:
        """A run is (word state, pending symbol): a symbol is fed when it is known not to end the word."""
        q, pending, total = (*(run or (0, "")), 0)
        for b in c.encode("utf-8", "surrogatepass"):
            if pending:
                q, gain = self.feed(q, pending)
                total += gain
            pending = self.merges.stand[b]
        return (q, pending), total

    def finish(self, run: tuple) -> int:
        return self.feed(run[0], self.merges.last[run[1]])[1]

    def word(self, text: str) -> int:
        run, total = None, 0
        for c in text:
            run, gain = self.letter(run, c)
            total += gain
        return total + self.finish(run)

    # -- the word pattern
    def step(self, sid: int, c: str) -> tuple[int, int]:
        kind, *rest = self.states[sid]
        cls = "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "P"
        before = 0
        if kind == "quote":
            held = rest[0]
            done = held + c
            if done in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                return self.known(("none",)), self.word(done)
            if done in ("'r", "'v", "'l"):
                return self.known(("quote", done)), 0
            run, gain = self.letter(None, held[0])
            if held == "'" and cls == "P":
                kind, rest, before = "P", [run], gain
            else:  # the quote stands alone; a letter behind it begins a word
                before = gain + self.finish(run)
                kind, rest = "none", []
                if len(held) > 1:
                    run, gain = self.letter(None, held[1])
                    kind, rest, before = "L", [run], before + gain
        if kind == cls and cls != "N":
            run, gain = self.letter(rest[0], c)
            return self.known((kind, run)), before + gain
        if kind in ("L", "P"):
            before += self.finish(rest[0])
        if cls == "N":
            return self.known(("none",)), before + self.word(c)
        if c == "'":
            return self.known(("quote", c)), before
        run, gain = self.letter(None, c)
        return self.known((cls, run)), before + gain

    def close(self, sid: int) -> int:
        kind, *rest = self.states[sid]
        if kind == "quote":
            return self.word(rest[0][0]) + (self.word(rest[0][1:]) if len(rest[0]) > 1 else 0)
        return 0 if kind == "none" else self.finish(rest[0])

    def known(self, state: tuple) -> int:
        sid = self.ids.get(state)
        if sid is None:
            sid = self.ids[state] = len(self.states)
            self.states.append(state)
        return sid

    def advance(self, s: int, text: str) -> tuple[int, int]:
        """The state after letters without white space, and the tokens that became complete."""
        total, steps = 0, self.steps
        for c in text:
            move = steps.get((s, c))
            if move is None:
                move = steps[s, c] = self.step(s, c)
            s = move[0]
            total += move[1]
        return s, total

    def closing(self, s: int) -> int:
        """Tokens that white space or the end completes."""
        n = self.closed.get(s)
        if n is None:
            n = self.closed[s] = self.close(s)
        return n

    # -- chunks: a map is (letters before the first space in pieces, count, state at the end); the state is None without a space
    def chunk_map(self, chunk: str) -> tuple[tuple[str, ...], int, int | None]:
        if ODD_SPACE.search(chunk):
            units = SPACES.split(chunk)
        else:
            units = chunk.split() or [""]
            if chunk[:1].isspace():
                units.insert(0, "")
            if chunk[-1:].isspace():
                units.append("")
        if len(units) == 1:
            return (units[0],), 0, None
        state, gain = self.reached[units[-1]]
        return (units[0],), sum(map(self.units.__getitem__, units[1:-1])) + gain, state

    def compose(self, f: tuple, g: tuple) -> tuple:
        head, count, state = f
        if state is None:
            return head + g[0], g[1], g[2]
        if state == 0 and g[2] is not None and len(g[0]) == 1:
            return head, count + self.units[g[0][0]] + g[1], g[2]
        for letters in g[0]:
            state, gain = self.advance(state, letters)
            count += gain
        return (head, count, state) if g[2] is None else (head, count + self.closing(state) + g[1], g[2])

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Prefix scan: pairs are composed, their scan taken, and the places between filled in."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.plain(p, chunk) for p in parts)
        return self.plain(text, chunk)

    def plain(self, text: str, chunk: int) -> int:
        if len(self.units) > KEEP_UNITS:
            self.units, self.reached = Units(self), Reached(self)
        if len(self.steps) > KEEP_STEPS:
            self.reset()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        start = ((), 0, 0)
        maps = [start, *(self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk))]
        _, total, state = self.scan(maps)[-1]
        return total + self.closing(state)


class Units(dict):
    """The composed steps of whole space-free units, from the start to the start."""

    def __init__(self, machine: Transducer):
        super().__init__({"": 0})
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        state, gain = self.machine.advance(0, unit)
        n = self[unit] = gain + self.machine.closing(state)
        return n


class Reached(dict):
    """The state that a unit's letters reach from the start, and the tokens complete by then."""

    def __init__(self, machine: Transducer):
        super().__init__({"": (0, 0)})
        self.machine = machine

    def __missing__(self, unit: str) -> tuple[int, int]:
        found = self[unit] = self.machine.advance(0, unit)
        return found


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def token_counter(path: str | None = None, vocabulary: str = "word_bpe_49k.json"):
    """A pandas UDF string -> long; ``path`` is the tokenizer file, else the installed one's place is looked up on each worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path is None:
            import public_tokenizers

        machine = compiled(path or public_tokenizers.path(vocabulary))
        for texts in batches:
            yield texts.map(machine.count).astype("int64")

    return count


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit; names that ``docs`` has already are replaced."""
    small_batches(docs.sparkSession)
    whole = no_null(text)
    d = docs.withColumn("n_bytes", F.octet_length(whole).cast("long")).withColumn("n_tokens", token_counter(path)(whole))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
