"""Operator 9, MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles. Sets that are equal form a class and only one
representative goes on. Each representative has ``BANDS x ROWS`` MinHash samples; the samples of a band
make a bucket key, and all samples are folded into a parity bitmap (odd sketch), whose XOR population
count estimates the similarity of a pair closely when it is high. Candidates of a bucket are compared
with its smallest member first, so a group of n copies makes n pairs; then, for buckets that still span
several components, members of different components are compared. A candidate is dropped by its sketch
only far below the threshold, and every link is confirmed on the full sets.

With 40 bands of 5 a pair at similarity 0.8 shares a bucket with probability 1 - 1.3e-7.

Defined cases: a document with fewer words than a shingle has its whole word sequence as the only
shingle; null, empty and blank texts have an empty set, linked with nothing. Classes, not ids, are linked, so rows
that share an id are told apart by their text. A row without an id is linked like any other, but names no component: its
component is the smallest id of the rows it is linked with, null if none has one. Repeated rows get the
same answer; a tie is settled by the smallest id. A text of any length is one row; its samples are drawn in slices.
An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, join_counted, keyed, lean, linked, materialize, meet, portions, release

BANDS, ROWS, SKETCH, SLACK, WHOLE = 40, 5, 512, 0.2, 2048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_mix = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the k-word shingles."""
    from xxhash import xxh3_64_intdigest as name

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([name(x) for x in w], np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _scramble((out + h[i : len(h) - k + 1 + i]) * _mix)
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    return _scramble(np.arange(1, n + 1, dtype=np.uint64) * _mix)


def sketch(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and odd sketch (as 64-bit words) of a set."""
    k = bands * rows
    seeds, low = _seeds(k), np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):  # bounded memory for very long texts
        x = s[a : a + 4096][None, :] ^ seeds[:, None]
        x *= _mix
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(1), out=low)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = _scramble((keys + low.reshape(bands, rows)[:, i]) * _mix)
    bits = np.bincount((_scramble(low + seeds) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def whole_sketch(s: np.ndarray) -> np.ndarray | None:
    """Odd sketch of all elements (a sample as large as the set), for sets of up to ``WHOLE``. The XOR of two
    has at most as many bits as the sets have elements that only one of them holds."""
    if len(s) > WHOLE:
        return None
    bits = np.bincount((_scramble(s * _mix) % np.uint64(2 * SKETCH)).astype(np.int64), minlength=2 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``id, th, n, c1, c2`` (class of equal sets), ``keys``, ``odd`` and ``all`` of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for batch in batches for x in portions(batch, "text")):
            rows = []
            for doc, th, text in zip(pdf["id"], pdf["th"], pdf["text"]):
                s = shingles(text, k)
                if not len(s):
                    rows.append((doc, th, 0, 0, 0, None, None, None))
                    continue
                c1, c2 = (int(x) for x in np.array([s.sum(dtype=np.uint64), _scramble(s).sum(dtype=np.uint64)], np.uint64).view(np.int64))
                rows.append((doc, th, len(s), c1, c2, *sketch(s), whole_sketch(s)))
            yield pd.DataFrame(rows, columns=["id", "th", "n", "c1", "c2", "keys", "odd", "all"])

    return docs.mapInPandas(lean(run), "id long, th int, n long, c1 long, c2 long, keys array<long>, odd array<long>, all array<long>")


def differing(a: Column, b: Column, bits: int = SKETCH) -> Column:
    """Population count of the XOR of two odd sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)), F.lit(0))


def most_differing(similarity: float, k: int = BANDS * ROWS) -> int:
    """Bits that differ, as expected at a similarity: its samples differ in k (1 - similarity) places, and
    each puts two bits into the XOR at random."""
    return math.ceil(SKETCH / 2 * (1 - math.exp(-4 * k * (1 - similarity) / SKETCH)))


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets reach the similarity; only texts of candidates are moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, text: str) -> np.ndarray:
            if i not in held:
                held[i] = shingles(text, k)
                if len(held) > 200:
                    held.popitem(last=False)
            return held[i]

        for pdf in batches:
            good = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    pairs = materialize(pairs, "near-likely")
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    need = reps.join(ends, "cid", "left_semi").select("cid", "first.id", "first.th")
    texts = materialize(docs.join(need, ["id", "th"]).select("cid", "text").dropDuplicates(["cid"]), "near-texts")
    side = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"t{c}"))
    out = materialize(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInPandas(lean(run), "a long, b long"), "near-confirmed")
    release(pairs, texts)
    return out


def grouped(src: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, th, n, first`` of every row of ``keyed``: set size and the first row (id and text hash) of its component."""
    sk = materialize(sketches(src, k), "sketch")
    some = ["n", "keys", "odd", "all"]
    reps = sk.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("id", "th")).alias("first"), *[F.first(c).alias(c) for c in some], F.count("*").alias("c"))
    reps = materialize(reps.withColumn("cid", F.monotonically_increasing_id()), "reps")  # fixed once written
    buckets = reps.select(F.col("cid").alias("id"), F.explode("keys").alias("key"))
    most = most_differing(percent / 100 - SLACK)

    def near(x: Column, y: Column) -> Column:
        sizes = F.lit(100) * F.least(x["n"], y["n"]) >= F.lit(percent) * F.greatest(x["n"], y["n"])
        apart = differing(x["all"], y["all"], 2 * SKETCH)  # null for large sets
        whole = F.coalesce((100 + percent) * apart <= (100 - percent) * (x["n"] + y["n"]), F.lit(True))
        return sizes & whole & (differing(x["odd"], y["odd"]) <= most)

    traits = reps.select(F.col("cid").alias("id"), F.struct("n", "odd", "all").alias("t"))
    comp = linked(meet(buckets, "near"), traits, near, lambda pairs: confirm(pairs, reps, src, k, percent), "near")
    named = reps.select("c1", "c2", "cid", "first", "c").join(comp.withColumnRenamed("id", "cid"), "cid", "left")
    best = named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("best"))
    named = named.join(best, "comp", "left").select("c1", "c2", "c", F.coalesce("best", "first").alias("first"))
    named = materialize(named, "near-named")
    release(reps, comp)
    own = sk.select("id", "th", "n", "c1", "c2")
    # empty sets need no class
    real = own.where("n > 0")
    out = join_counted(real, named, ["c1", "c2"], "c", sk.count())
    return out.select("id", "th", "n", "first").unionByName(own.where("n = 0").select("id", "th", "n", F.struct("id", "th").alias("first")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row; ids are integers."""
    out = grouped(keyed(docs, id_col, text_col), k, percent)
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(known(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), known(F.col("first.id")).alias("component_id"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: five-word shingles at 0.8; of each group the row of smallest id stays (rows without an id come last),
    of rows equal in id and text one."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = [F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.hash(F.col("row.text")).alias("th")]
    out = grouped(keyed(docs, "doc_id", "text"), 5, 80)
    keep = out.where((F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))).groupBy("id", "th").agg(F.max("n").alias("n"))
    # an empty set is linked with nothing, so each of its rows stays
    one = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0)))
    found = own.select("row", *key).join(keep, ["id", "th"]).withColumn("r", one).where((F.col("r") == 1) | (F.col("n") == 0))
    return found.select("row.*")
