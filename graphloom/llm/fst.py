"""Operator 8, token counts: a finite-state tokenizer compiled to transducers.

Two deterministic transducers are composed. The first is the pre-tokenizer of byte-level BPE vocabularies
(``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``) over character classes; it
emits word borders. Texts are cut into chunks without regard to word borders; every chunk yields a map from start
state to end state, the maps are composed by a parallel prefix scan, and with its true start state each chunk emits
its borders. The second reads a word's characters from the start state; the transition by which a
border closes a word carries the number of tokens that it emits. It is compiled on demand: a transition that
isn't there yet is added, and a closing transition gets its count from the vocabulary's own merges when it is first
taken. All words of a portion are read at once, one character a step. At ``STATES`` states it is emptied, so
memory is bounded; words of over ``LONG`` characters are merged each time.

Defined cases: null and empty texts have 0 tokens; a special string of the vocabulary inside a text
is one token, as is the library's default. Very long texts are cut where a border is certain. Only the text goes
through Python, so ids of any kind, null ones too, and all else stay as they are; ties and repeated rows are
independent, empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyTable, lean, slices

CHUNK, STATES, LONG, SPECIAL = 256, 1_500_000, 48, "<|endoftext|>"
PART, BORDER = 1 << 19, re.compile("(?<=[A-Za-z0-9])(?=[ \n])")
# states
START, LET, NUM, PUN, APO, RV, LL, CON, S1, W1, S2, W2 = range(12)
# classes: other letters, letters that end a contraction, r v, l, e, digits, ', other marks, space, other white space, end
(C_LET, C_STMD, C_RV, C_L, C_E, C_NUM, C_APO, C_PUN, C_SP, C_WS, C_END) = range(11)
HERE, BEFORE = 1, 2  # a border before this character; before the one before


def _step(state: int, c: int) -> tuple[int, int]:
    first = {C_NUM: NUM, C_APO: APO, C_PUN: PUN, C_SP: S1, C_WS: W1, C_END: START}.get(c, LET)
    letter, mark, white = c <= C_E, c in (C_APO, C_PUN), c in (C_SP, C_WS)
    if c == C_END:
        return START, HERE | (BEFORE if state in (RV, LL) else 0)
    if state in (S1, W1, S2, W2):
        if white:
            return (S2 if c == C_SP else W2), 0
        late = BEFORE if state in (S2, W2) else 0
        if state in (S1, S2):  # the space belongs to what follows; a mark after it starts no contraction
            return (LET if letter else NUM if c == C_NUM else PUN), late
        return first, late | HERE
    if state == LET and letter or state == NUM and c == C_NUM or state == PUN and mark:
        return state, 0
    if state == APO:
        if mark:
            return PUN, 0
        if c in (C_STMD, C_RV, C_L):
            return {C_STMD: CON, C_RV: RV, C_L: LL}[c], 0
    if state == RV and c == C_E or state == LL and c == C_L:
        return CON, 0
    if state in (RV, LL):
        return (LET, BEFORE) if letter else (first, BEFORE | HERE)
    return first, HERE


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition table, border table and the class of every code point."""
    import regex

    nxt, emit = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    for s in range(12):
        for c in range(11):
            nxt[s, c], emit[s, c] = _step(s, c)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    cls = np.full(0x110000, C_PUN, np.uint8)
    for pattern, c in ((r"\p{L}+", C_LET), (r"\p{N}+", C_NUM), (r"\s+", C_WS)):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            cls[a:b] = c
    for chars, c in (("stmd", C_STMD), ("rv", C_RV), ("l", C_L), ("e", C_E), ("'", C_APO), (" ", C_SP)):
        for x in chars:
            cls[ord(x)] = c
    return nxt, emit, cls


def borders(cls: np.ndarray) -> np.ndarray:
    """Whether a word starts at each position of a class sequence that ends in ``C_END``."""
    nxt, emit, _ = transducer()
    n = len(cls)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, C_END, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = nxt.T.reshape(-1).astype(np.uint8)  # by class, then state
    maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
    for col in grid:  # the state map of every chunk
        maps = flat[(col.astype(np.int16) * 12)[:, None] + maps]
    step = 1
    while step < rows:  # prefix scan: maps[i] becomes the map of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), 1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    emits = emit.T.reshape(-1)
    for i, col in enumerate(grid):
        at = col.astype(np.int16) * 12 + state
        out[i], state = emits[at], flat[at]
    out = out.T.reshape(-1)[:n]
    here = (out & HERE) > 0
    here[:-1] |= (out[1:] & BEFORE) > 0
    return here


class Words:
    """Transducer over the characters of a word. Transitions are an open hash table of (state, character)."""

    def __init__(self, states: int = STATES):
        self.most = states
        self.clear()

    def clear(self) -> None:
        self.table, self.emit, self.n = KeyTable(self.most), np.full(self.most + 1, -1, np.int32), 1

    def _add(self, keys: np.ndarray) -> None:
        new = np.unique(keys)
        self.table.add(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
        self.n += len(new)

    def read(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """End state of each word; ``sizes`` fall."""
        state = np.zeros(len(starts), np.uint64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -k, "left"))  # words of more than k characters
            keys = (state[:m] << np.uint64(21) | codes[starts[:m] + k]) + np.uint64(1)
            at = self.table.places(keys)
            lack = self.table.keys[at] == 0
            if lack.any():
                self._add(keys[lack])
                at[lack] = self.table.places(keys[lack])
            state[:m] = self.table.to[at]
        return state.astype(np.int64)


class Counter:
    """Counts of one vocabulary: ranks file of byte-level BPE."""

    def __init__(self, ranks_path: str, pattern: str, special: str = SPECIAL):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merged = lambda word: len(encoding._encode_single_piece(word))  # the merges alone, no pattern
        self.special, self.words = special, Words()

    def _parts(self, text: str) -> Iterator[str]:
        """Texts between special strings, cut where a border is certain."""
        for own in text.split(self.special) if self.special in text else [text]:
            a = 0
            while len(own) - a > 2 * PART and (m := BORDER.search(own, a + PART)):
                yield own[a : m.start()]
                a = m.start()
            yield own[a:] if a else own

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        total, owner, parts = [t.count(self.special) for t in texts], [], []
        for i, t in enumerate(texts):
            for own in self._parts(t):
                owner.append(i)
                parts.append(own)
        for lo, hi in slices([len(p) for p in parts], 2 * PART):
            for i, n in zip(owner[lo:hi], self._count(parts[lo:hi])):
                total[i] += n
        return total

    def _count(self, parts: list[str]) -> list[int]:
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = transducer()[2][codes]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        cls[ends] = C_END
        here = borders(cls)
        here[ends] = True
        cuts = np.flatnonzero(here)
        starts = np.r_[0, cuts[:-1]]
        starts[np.searchsorted(cuts, ends[:-1]) + 1] += 1  # the newline between parts
        sizes = cuts - starts
        emitted = np.zeros(len(cuts), np.int64)
        for j in np.flatnonzero(sizes > LONG).tolist():
            emitted[j] = self.merged(joined[starts[j] : cuts[j]])
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        short = short[np.argsort(-sizes[short], kind="stable")]
        at = 0
        while at < len(short):  # as many words as there is surely room for
            if self.words.most - self.words.n < self.words.most // 16:
                self.words.clear()
            room = int(np.searchsorted(np.cumsum(sizes[short[at:]]), self.words.most - self.words.n, "right"))
            some = short[at : at + room]
            state = self.words.read(codes, starts[some], sizes[some])
            lack, first = np.unique(state[self.words.emit[state] < 0], return_index=True)
            if len(lack):
                from_ = some[np.flatnonzero(self.words.emit[state] < 0)[first]].tolist()
                self.words.emit[lack] = [self.merged(joined[starts[j] : cuts[j]]) for j in from_]
            emitted[some] = self.words.emit[state]
            at += room
        sums = np.r_[0, np.cumsum(emitted)]
        last = np.searchsorted(cuts, ends) + 1
        return np.diff(np.r_[0, sums[last]]).tolist()


@lru_cache(2)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


def count_tokens(docs: DataFrame, ranks: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. ``ranks``: the vocabulary's ranks file."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(ranks, pattern)
        for texts in batches:
            yield pd.Series(c.counts([t or "" for t in texts]), dtype="int64")

    def lean_run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(run)(batches)

    tokens = F.pandas_udf(lean_run, "long")
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n_bytes.alias("n_bytes"), tokens(F.col(f"`{text_col}`")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
