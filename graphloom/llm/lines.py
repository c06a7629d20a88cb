"""Operator 2, line dedup: fuzzy lines.

Lines are normalised to their words in lower case; equal ones form a class. Two classes are linked if the edit
similarity of their words is at least 0.8. Blocks that linked lines must share come from the pigeonhole principle:
at most ``allowed`` words of the longer line are edited, so a line lacks at most ``lost`` of the other's grams of
``GRAM`` words, and its ``lost + 1`` first grams in one order of all grams meet the other line's. Of these the
first ``KEYS`` are the blocks that are joined: all of them for lines of up to about a dozen words (nothing is lost),
and a bottom-k sketch of the grams for longer ones, which finds a pair at similarity 0.8 with probability 0.95 or
more (README). Lines of five words, whose runs may be shorter, are met by the line with one word left out.
The lines of a block are compared where they lie, and no pair becomes a row: by their lengths and by the parities of
their words in ``64 * ODD`` bits, of which an edit changes two at most (one that inserts, one). Lines that have a partner
left get their words, and links are verified by the edit distance, only those between lines that verified links don't
join yet; links are the rows that come out, fewer than lines went in. A pair that shares several blocks is compared in the one of smallest key. One
occurrence stays of each connected group: the first by document id, line and text.

The blocks are blocks of words and not of the SimHash: at similarity 0.8 SimHashes of 64 bits differ in 13 bits on
average, which no split into selective blocks meets (README has figures).

Words are runs of word characters; in scripts written without blanks (``UNSPACED``) each character is a word. A
line without a word (a rule, a bracket) has its runs between blanks as words. So every line that isn't blank counts,
a line of fewer than five words by equality, as no edit of it leaves 0.8.

Defined cases: blank lines are never removed; null text has no lines and stays null, empty text stays empty; a row
without an id comes after all others; rows that share an id are told apart by their text, and rows equal in both are one
row (they keep and lose the same lines); an empty table gives an empty result; a text of any length is read in one
piece, its lines in portions. Other columns pass through under any name; ``n_lines`` and ``n_removed`` of the input
are replaced. Lines are separated by a newline and keep their order and own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import NO_ID, components, join_counted, lean, materialize, portions, release, slices

PERCENT, BROADCAST = 80, 1_000_000
CLOSE = 0.65  # of the bits in which linked lines may differ: those that differ in fewer are nearly all linked
GRAM, KEYS, ODD, LINE_BITS = 3, 8, 4, 11  # words of a gram, most keys of a line, 64-bit words of the parities
CHUNK, PART = 1 << 20, 1 << 21  # keys dealt at once, keys compared at once
ROWS, TEXTS, PAIRS = 250_000, 20_000, 1 << 16  # of a task: rows of blocks, those with their words; pairs compared at once
WINDOW, WORDS = 1 << 20, 500_000  # bytes and words in hand at once
PUNCTUATION = ".,;:!?'\"()-"
#: Thai to Myanmar, Khmer, New Tai Lue to Tai Tham, kana with marks, Han; not Hangul and others that part words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1980-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD, UNSPACED_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+"), re.compile(f"[{UNSPACED}]")


def plain(text: str) -> str:
    """In lower case, with the marks that often part words as blanks."""
    text = text.lower()
    for mark in PUNCTUATION:
        text = text.replace(mark, " ")
    return text


def cut(line: str) -> list[str]:
    """The words of a line that :func:`plain` made."""
    words = line.split()  # cheaper than the pattern, and the same if nothing else parts words
    own = "".join(words)
    return words if own.isalnum() and (own.isascii() or not UNSPACED_WORD.search(own)) else WORD.findall(line)


def normalised(line: str) -> list[str]:
    return cut(plain(line)) or line.split()


def similar(a: list[str], b: list[str], percent: int = PERCENT) -> bool:
    """Whether the edit distance in words leaves ``percent`` of the longer list. The distance is counted in bit vectors of
    the shorter one (a column of the table at once), after a bound by the words that only one has."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(a), len(b)
    most = m * (100 - percent) // 100
    if m - n > most:
        return False
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    n, m = len(a), len(b)
    if not n:
        return True
    own: dict[str, int] = {}
    for x in a:
        own[x] = own.get(x, 0) + 1
    common = 0
    for x in b:
        if own.get(x, 0):
            own[x] -= 1
            common += 1
    if m - common > most:
        return False
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = every, 0, n
    for j, x in enumerate(b):
        here = at.get(x, 0)
        zero = (((here & up) + up) ^ up) | here | down
        right, left = down | ~(zero | up) & every, up & zero
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        if distance - (m - 1 - j) > most:
            return False
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | ~(zero | right) & every, right & zero
    return distance <= most


def allowed(n: int) -> int:
    """Most edits between linked lines the longer of which has ``n`` words."""
    return n * (100 - PERCENT) // 100


@lru_cache(1 << 16)
def lost(n: int) -> int:
    """Most grams of a line of ``n`` words that a linked line can lack: an edit breaks ``GRAM``, but one less if it
    inserts, and a line longer by j has j insertions at least."""
    return max(GRAM * allowed(n + j) - j for j in range(n // 3 + 2) if j <= allowed(n + j))


_LOST = np.array([lost(n) for n in range(64)])


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of several hashes in order."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xD6E8FEB86659FD93)


#: Bytes as words see them: capitals small, all but letters, digits, ``_`` and what isn't ASCII as blanks.
FOLD = bytes(c if c >= 128 or c in b"0123456789_abcdefghijklmnopqrstuvwxyz\n" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BARE = bytes(c if c > 32 or c == 10 else 32 for c in range(256))
NO_WORD = re.compile(rf"[^\x00-\x7f\w{UNSPACED}]+")
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)  # a number for each byte
_P = 0x9E3779B97F4A7C15
_POW, _INV = (np.cumprod(np.full(WINDOW + 1, x, np.uint64)) for x in (_P, pow(_P, -1, 1 << 64)))


def folded(text: str) -> bytes:
    """A text whose words :data:`FOLD` parts as :func:`normalised` does, line by line."""
    if text.isascii():
        return text.encode()
    low = NO_WORD.sub(" ", text.lower())
    if UNSPACED_WORD.search(low):
        low = UNSPACED_WORD.sub(r" \g<0> ", low)
    return low.encode("utf-8", "surrogatepass")


def words_of(text: bytes, fold: bytes = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length in bytes of every word, and the words of every line; the text ends with a newline."""
    x = np.frombuffer(text.translate(fold), np.uint8)
    own = x > 32
    edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.diff(np.searchsorted(starts, np.flatnonzero(x == 10)), prepend=0)
    w, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):  # the words of a window at once: sums of powers from its start
        hi = max(int(np.searchsorted(ends, starts[lo] + WINDOW, "right")), lo + 1)
        a, b = starts[lo], ends[hi - 1]
        if b - a > WINDOW:  # a longer word
            w[lo] = xxhash.xxh3_64_intdigest(x[a:b].tobytes())
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[x[a:b]] * _POW[: b - a], out=sums[1:])
            w[lo:hi] = (sums[ends[lo:hi] - a] - sums[starts[lo:hi] - a]) * _INV[starts[lo:hi] - a]
        lo = hi
    return _mixed([w, (ends - starts).astype(np.uint64)]), ends - starts, sizes


def parities(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ODD`` 64-bit words a line (none is empty): whether a bit is that of an odd number of its words."""
    bit, column, starts = np.uint64(1) << (w & np.uint64(63)), (w >> np.uint64(6)) % np.uint64(ODD), np.cumsum(sizes) - sizes
    return np.stack([np.bitwise_xor.reduceat(np.where(column == i, bit, np.uint64(0)), starts) for i in range(ODD)], 1).view(np.int64)


def keys_of(w: np.ndarray, long: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``KEYS`` keys a line (0: none): lines that :func:`similar` links share one, if they have no more keys than that.

    Grams are taken in the order of a hash, those of few letters (which are common) last."""
    starts, out = np.cumsum(sizes) - sizes, np.zeros((len(sizes), KEYS), np.uint64)
    short = allowed(GRAM + 2) + GRAM  # 4: a line of one word more can share only two words in a row
    for n in (short, short + 1):
        of = np.flatnonzero(sizes == n)
        words = [w[starts[of] + i] for i in range(n)]
        for j, cut_out in enumerate([n] if n == short else range(n)):
            out[of, j] = _mixed([c for i, c in enumerate(words) if i != cut_out])
    if len(w) < GRAM:
        return out
    line = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((line[: 1 - GRAM] == line[GRAM - 1 :]) & (sizes[line[: 1 - GRAM]] > short))
    letters = sum(long[at + i] for i in range(GRAM))
    common = ((letters < 15).astype(np.uint64) + (letters < 10)) << np.uint64(62 - LINE_BITS)
    gram, line = _mixed([w[at + i] for i in range(GRAM)]) >> np.uint64(2 + LINE_BITS) | common, line[at]
    for lo in range(0, len(sizes), 1 << LINE_BITS):  # a line's place and its gram are one number, which sorts at once
        a, b = np.searchsorted(line, (lo, lo + (1 << LINE_BITS)))
        x = np.sort((line[a:b] - lo).astype(np.uint64) << np.uint64(64 - LINE_BITS) | gram[a:b])
        x = x[np.r_[True, x[1:] != x[:-1]][: len(x)]]
        own = (x >> np.uint64(64 - LINE_BITS)).astype(np.int64) + lo
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        keep = nth < np.minimum(_LOST[np.minimum(sizes[own], 63)] + 1, KEYS)
        nth += np.where(sizes[own] == short + 1, short + 1, 0)  # after the lines with a word left out
        out[own[keep], nth[keep]] = x[keep] & np.uint64((1 << (64 - LINE_BITS)) - 1) | np.uint64(1 << 63)
    return out


def names(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each line (none is empty) by its words in order."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(w)) - np.repeat(starts, sizes)
    turn = _mixed([place.astype(np.uint64)]) | np.uint64(1)
    one, two = (np.add.reduceat(_mixed([w ^ np.uint64(k)]) * turn, starts) for k in (1, 2))
    return one.view(np.int64), (two + sizes.astype(np.uint64)).view(np.int64)


PARITIES = [f"o{i}" for i in range(ODD)]
LONGS = ", ".join(f"{c} long" for c in PARITIES)


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _occurrences(docs: DataFrame) -> DataFrame:
    """``id, th, line, h1, h2, n, o0, ..., keys`` of every line that isn't blank: its class, words, parities and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, ids, th = batch.column("text").to_pylist(), batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for lo, hi in slices([len(t or "") for t in every], WINDOW):
                yield from part([t or "" for t in every[lo:hi]], ids[lo:hi], th[lo:hi])

    def part(texts: list[str], ids: np.ndarray, th: np.ndarray) -> Iterator[pa.RecordBatch]:
        blobs = [folded(t) for t in texts]
        counts = np.array([b.count(10) + 1 for b in blobs])
        doc, line = np.repeat(np.arange(len(texts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        w, long, sizes = words_of(b"\n".join(blobs) + b"\n")
        yield from rows(ids, th, doc, line, w, long, sizes)
        bare = [(i, k) for i, k in zip(doc[sizes == 0].tolist(), line[sizes == 0].tolist())]
        lines = {i: texts[i].split("\n") for i in {i for i, _ in bare}}
        bare = [(i, k) for i, k in bare if lines[i][k].strip()]  # lines without a word: their runs between blanks
        if bare:
            blob = "\n".join(" ".join(lines[i][k].split()) for i, k in bare) + "\n"
            yield from rows(ids, th, *np.array(bare).T, *words_of(blob.encode("utf-8", "surrogatepass"), BARE))

    def rows(ids: np.ndarray, th: np.ndarray, doc: np.ndarray, line: np.ndarray, w: np.ndarray, long: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        real = np.flatnonzero(sizes)
        doc, line, sizes = doc[real], line[real], sizes[real]
        ends = np.cumsum(sizes)
        for lo, hi in slices(sizes.tolist(), WORDS):
            a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
            own, n = w[a:b], sizes[lo:hi]
            odd, (h1, h2) = parities(own, n), names(own, n)
            got = {"id": ids[doc[lo:hi]], "th": th[doc[lo:hi]], "line": line[lo:hi].astype(np.int32), "h1": h1, "h2": h2, "n": n.astype(np.int32)}
            got |= {c: odd[:, i] for i, c in enumerate(PARITIES)} | {"keys": _fixed(keys_of(own, long[a:b], n))}
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in got.items()})

    return docs.mapInArrow(lean(run), f"id long, th int, line int, h1 long, h2 long, n int, {LONGS}, keys binary")


def _texts(need: DataFrame, docs: DataFrame) -> DataFrame:
    """``cid, words`` (a text) of the classes asked for (``cid, id, th, line``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(pdf, "text", 2 << 20):
                out = [(x["cid"], " ".join(normalised(cut_[x["line"]]))) for text, own in zip(part["text"], part["own"]) for cut_ in [text.split("\n")] for x in own]
                yield pd.DataFrame(out, columns=["cid", "words"])

    by = need.groupBy("id", "th").agg(F.collect_list(F.struct("cid", "line")).alias("own"))
    near = F.broadcast if need.count() <= BROADCAST else (lambda d: d)
    return docs.join(near(by), ["id", "th"]).select("text", "own").mapInPandas(lean(run), "cid long, words string").dropDuplicates(["cid"])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a neighbour in the sorted keys is equal."""
    same = np.r_[False, keys[1:] == keys[:-1], False]
    return (same[1:] | same[:-1])[: len(keys)]


def _buckets(occ: DataFrame) -> DataFrame:
    """``h1, ks``: the keys of a class that other classes have too; classes without such keys aren't listed.

    Most keys occur once. They travel as packed arrays, dealt by key into parts of about ``PART``. A
    chunk of about ``CHUNK`` keys first finds those that several of its classes have: these rows are known to be
    shared and pass by, dealt evenly, and one row stands for them among the chunk's keys. So a key that
    very many lines have comes to its part at most once a chunk.
    """
    parts = _parts(occ, -(-PART // KEYS))

    def packed(part, known: bool, keys: np.ndarray, ids: np.ndarray):
        return (int(part), known, keys.tobytes(), ids.tobytes())

    def once(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In the order of keys; of a key that only copies of a line have one row stays."""
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])][: len(keys)]
        return keys[new], ids[new]

    def chunk(keys: np.ndarray, ids: np.ndarray, turn: int) -> pd.DataFrame:
        keys, ids = once(keys, ids)
        twice = _repeated(keys)
        known, own = keys[twice], ids[twice]
        rows = [packed((turn + lo // 4096) % parts, True, known[lo : lo + 4096], own[lo : lo + 4096]) for lo in range(0, len(known), 4096)]
        first = np.r_[True, keys[1:] != keys[:-1]]
        keys, ids = keys[first], ids[first]
        part = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        keys, ids, part = keys[order], ids[order], part[order]
        names, starts = np.unique(part, return_index=True)
        rows += [packed(p, False, keys[a:b], ids[a:b]) for p, a, b in zip(names, starts, [*starts[1:], len(part)])]
        return pd.DataFrame(rows, columns=["part", "known", "keys", "ids"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, turn = [], 0, TaskContext.get().partitionId() * 7919
        for batch in chain(batches, [None]):
            if batch is not None and len(batch):
                keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
                ids = np.repeat(batch.column("h1").to_numpy(), KEYS)[keys != 0]
                held.append((keys[keys != 0], ids))
                n += len(ids)
            if n and (batch is None or n >= CHUNK):
                keys, ids = (np.concatenate(x) for x in zip(*held))
                held, n, turn = [], 0, turn + 31
                yield pa.RecordBatch.from_pandas(chunk(keys, ids, turn), PACKED, preserve_index=False)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda keys, ids: pd.DataFrame({"key": keys.view(np.int64), "h1": ids})
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in batches:
            for known, k, i in zip(pdf["known"], pdf["keys"], pdf["ids"]):
                pair = np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64)
                if known:
                    yield table(*pair)
                else:
                    held.append(pair)
        if held:
            keys, ids = (np.concatenate(x) for x in zip(*held))
            del held
            keys, ids = once(keys, ids)
            twice = _repeated(keys)
            keys, ids = keys[twice], ids[twice]
            for lo in range(0, len(keys), 1 << 16):
                yield table(keys[lo : lo + (1 << 16)], ids[lo : lo + (1 << 16)])

    dealt = occ.select("h1", "keys").mapInArrow(lean(spread), "part int, known boolean, keys binary, ids binary").repartition(parts, "part")
    return dealt.mapInPandas(lean(find), "key long, h1 long").groupBy("h1").agg(F.collect_set("key").alias("ks"))


PACKED = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary())])


def _parts(rows: DataFrame, most: int) -> int:
    """Number of parts of about ``most`` of the rows, not less than Spark's own."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """All rows of a task by column, in the order of their blocks and lengths; ``at`` numbers the blocks, ``ks`` are filled up with 0."""
    table = pa.Table.from_batches(held) if (held := [b for b in batches if len(b)]) else None
    if table is None:
        return {}
    got = {c: table.column(c).to_numpy() for c in table.column_names if c != "ks"}
    lists = table.column("ks").combine_chunks()
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    ks = np.zeros((len(sizes), KEYS), np.int64)
    ks[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    got |= {"ks": ks, "odd": np.stack([got.pop(c) for c in PARITIES], 1).view(np.uint64)}
    order = np.lexsort((got["n"], got["q"], got["p"], got["key"]))
    got = {c: x[order] for c, x in got.items()}
    new = np.zeros(len(order), bool)
    for c in ("key", "p", "q"):
        new[1:] |= got[c][1:] != got[c][:-1]
    return got | {"at": np.cumsum(new)}


def _near(t: dict[str, np.ndarray], part: float, done: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (places) of a block that may be linked, portion by portion, without those that are ``done`` before
    their portion; of lines that share several blocks in that of smallest key."""
    n = t["n"].astype(np.int64)
    rank = (t["at"].astype(np.int64) << 32) + n
    last = np.searchsorted(rank, rank - n + n * 100 // PERCENT, "right")  # longer lines aren't linked
    counts = last - np.arange(len(n)) - 1
    sums = np.cumsum(counts)
    lo = 0
    while lo < len(n):
        hi = max(int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PAIRS, "right")), lo + 1)
        own = counts[lo:hi]
        a = np.repeat(np.arange(lo, hi), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        lo = hi
        keep = (t["p"][a] == t["q"][a]) | (t["blk"][a] != t["blk"][b])
        a, b = a[keep], b[keep]
        most = (2 * (n[b] * (100 - PERCENT) // 100) - n[b] + n[a]) * part
        keep = sum(np.bitwise_count(t["odd"][a, i] ^ t["odd"][b, i]).astype(np.int64) for i in range(ODD)) <= most
        a, b = a[keep], b[keep]
        keep = ~done(a, b)
        a, b = a[keep], b[keep]
        x, y = t["ks"][a], t["ks"][b]
        common_ = (x[:, :, None] == y[:, None, :]).any(2) & (x != 0)
        keep = np.where(common_, x, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == t["key"][a]
        yield a[keep], b[keep]


def _met(rows: DataFrame) -> DataFrame:
    """``key, cid`` of the rows of blocks that have a partner there to which they may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if t := _columns(batches):
            met = np.zeros(len(t["n"]), bool)
            for a, b in _near(t, 1.0, lambda a, b: met[a] & met[b]):
                met[a] = met[b] = True
            yield pa.RecordBatch.from_pydict({c: pa.array(t[c][met]) for c in ("key", "cid")})

    return common.dealt(rows, "cid").repartition(_parts(rows, ROWS), "key", "p", "q").mapInArrow(lean(run), "key long, cid long").distinct()


def _links(part: float) -> Callable[[DataFrame], DataFrame]:
    """How :func:`common._across` compares rows (with ``words``): links ``ia, ib`` between their components, enough to join all that any link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (t := _columns(batches)):
            return
        comp = np.unique(t["comp"], return_inverse=True)[1]
        to, words = np.arange(comp.max() + 1), {}

        def root(x: int) -> int:
            while to[x] != x:
                to[x] = x = to[to[x]]
            return x

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            while (to[to] != to).any():
                to[:] = to[to]
            return to[comp[a]] == to[comp[b]]

        def of(i: int) -> list[str]:
            if (cid := t["cid"][i]) not in words:
                words[cid] = t["words"][i].split()
            return words[cid]

        links = []
        for a, b in _near(t, part, joined):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = root(comp[i]), root(comp[j])
                if x != y and similar(of(i), of(j)):
                    to[x] = y
                    links.append((min(t["cid"][i], t["cid"][j]), max(t["cid"][i], t["cid"][j])))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"ia": pa.array(pairs[:, 0]), "ib": pa.array(pairs[:, 1])})

    return lambda rows: rows.repartition(_parts(rows, TEXTS), "key", "p", "q").mapInArrow(lean(run), "ia long, ib long")


def _linked(classes: DataFrame, occ: DataFrame, docs: DataFrame) -> DataFrame:
    """Components ``id, comp`` of the classes under the links of those that share a block."""
    shared = materialize(classes.join(_buckets(occ), "h1").select("cid", "n", *PARITIES, "ks"), "lines-shared")
    rows = shared.withColumn("key", F.explode("ks"))
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > min(common.MANY, common.SALT)), "lines-sizes")
    sized = lambda d: d.join(F.broadcast(sizes), "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    met = materialize(_met(sized(rows)), "lines-met")
    need = materialize(classes.select("cid", "id", "th", "line").join(met.select("cid").distinct(), "cid", "left_semi"), "need")
    traits = materialize(_texts(need, docs).join(shared, "cid"), "lines-words")
    near = sized(met.join(traits, "cid"))
    large, first = near.where(F.col("m") > common.MANY), None
    compare = lambda rows, part: materialize(common._across(rows, _links(part)), "lines-links").toDF("a", "b")
    if sizes.where(F.col("m") > common.MANY).isEmpty():
        links = compare(near.withColumn("comp", F.col("cid")), 1.0)
    else:  # close rows first: they join most of a group of near copies, and all tasks that have a part of it know so
        first = compare(large.withColumn("comp", F.col("cid")), CLOSE)
        comp = components(first, "lines").withColumnRenamed("id", "cid")
        links = compare(near.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), 1.0).union(first)
    out = components(links, "lines")
    release(shared, sizes, met, need, traits)
    return out


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``id, th, line, first_id, first_line`` of every line to remove; docs: ``id, th, text``."""
    occ = materialize(_occurrences(docs), "lines")
    carried = ["id", "th", "line", "n", *PARITIES]  # of any occurrence; all of one width, so nothing is sorted
    classes = occ.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in carried], F.count("*").alias("c"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # fixed once written
    comp = _linked(classes, occ, docs)
    group = classes.select("cid", "h1", "h2", "c").join(comp.withColumnRenamed("id", "cid"), "cid", "left").where("comp is not null or c > 1")
    group = materialize(group.select("h1", "h2", "c", F.coalesce("comp", "cid").alias("g")), "kept")
    places = materialize(join_counted(occ.select("id", "th", "line", "h1", "h2"), group, ["h1", "h2"], "c", occ.count()).select("id", "th", "line", "g"), "places")
    best = materialize(places.groupBy("g").agg(F.min(F.struct("id", "line", "th")).alias("best"), F.count("*").alias("c")), "best")
    out = join_counted(places, best, ["g"], "c", places.count())
    out = out.where((F.col("id") != F.col("best.id")) | (F.col("line") != F.col("best.line")) | (F.col("th") != F.col("best.th")))
    out = materialize(out.select("id", "th", "line", F.col("best.id").alias("first_id"), F.col("best.line").alias("first_line")), "drop")
    release(occ, classes, group, places, best, comp)
    return out


def _without(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept`` (text), ``n_lines`` and ``n_removed``."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    own = own.select("row", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("th"))
    drop = duplicate_lines(own.select("id", "th", text.alias("text"))).groupBy("id", "th").agg(F.collect_set("line").alias("drop"))
    drop = materialize(drop, "drops")
    small = drop.count() <= BROADCAST // 2  # else the smaller side is hashed, so that texts aren't sorted
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("drop", i))
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(left, "\n"))  # other texts aren't split
    lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    gone = F.coalesce(F.when(F.col("drop").isNotNull(), F.size("drop")), F.lit(0)).cast("long")
    return own.join(F.broadcast(drop) if small else drop.hint("shuffle_hash"), ["id", "th"], "left").select("row", kept.alias("kept"), lines.alias("n_lines"), gone.alias("n_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their text, and ``n_lines, n_removed``."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    fields = [F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest]
    return _without(docs, id_col, text_col).select(*fields, "n_lines", "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: texts without the lines that another document or place already has; no row goes."""
    fields = [F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return _without(docs, "doc_id", "text").select(*fields)
