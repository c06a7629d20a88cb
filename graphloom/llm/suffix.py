"""Operator 5, suffix-array dedup: byte strings of ``WINDOW`` bytes that occur more than once go.

Bucket-pointer refinement over all suffixes, cut off at depth ``WINDOW``: the suffixes of a text first
fall into buckets by their ``Q`` bytes, and a bucket is refined by the bucket identifiers of suffixes
``Q``, ``2Q``, ``4Q`` ... bytes further on; each refinement's identifiers serve the next (25, 50, 100,
200, 400 bytes). Identifiers are 64-bit names that are equal everywhere for equal strings, so texts
are refined where they lie. To meet across texts, the suffixes of every window are represented by its
smallest 100-byte bucket (consecutive windows mostly share it): rows of a shared bucket are counted,
and buckets whose rows differ are refined again by the identifiers of later offsets, first for 16
windows at once (strings common to all of them), then window by window. Every count is an
aggregation with partial sums; no bucket is gathered in one task and no pair is made. A string is
known by two names that were made apart (its bucket and its content).

Defined cases: null text is empty; texts under ``WINDOW`` bytes lose nothing; overlapping and repeated
occurrences count, within a text too; repeated rows are each other's copies; an empty table gives an
empty result. Rows may share an id or have none: they are told apart by their text, and rows equal in both have the
same answer. Very long texts are read in blocks of 256 KiB that overlap by a window. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, join_counted, keyed, lean, materialize, portions, release

WINDOW, Q, REACH = 400, 25, 300  # REACH: a window's 100-byte buckets start 0..300 bytes after it
BLOCK, WIDTH = 1 << 18, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: bytes) -> dict[int, np.ndarray]:
    """Bucket identifiers at 100, 200 and 400 bytes of every suffix that is long enough."""
    h = _mix(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), np.uint64(0))
    one, at, n = h, {}, 1
    while n < 16:
        h, n = _mix(h[: max(0, len(h) - n)], h[n:]), 2 * n
        at[n] = h
    h = _mix(h[: max(0, len(h) - 8)], at[8][16:])
    h = _mix(h[: max(0, len(h) - 1)], one[24:])
    n = Q
    while n < WINDOW:
        h, n = _mix(h[: max(0, len(h) - n)], h[n:]), 2 * n
        at[n] = h
    return at


def groups(data: bytes, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one smallest bucket: first window, number, offset of the
    bucket in the first window, bucket, name of the whole. ``valid``: windows that lie in one text."""
    at = identifiers(data)
    h100, h400 = at[100], at[400]
    n = len(h400)
    if not n or not valid.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    key = (_mix(h100, _B) & ~np.uint64((1 << 20) - 1)) | np.arange(len(h100), dtype=np.uint64)
    w = 1
    while 2 * w <= REACH + 1:
        key, w = np.minimum(key[:-w], key[w:]), 2 * w
    low = np.minimum(key[:n], key[REACH + 1 - w : REACH + 1 - w + n])
    p = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    p[~valid] = -1
    cut = np.flatnonzero(np.diff(p, prepend=-2))
    first, last = cut, np.append(cut[1:], n) - 1
    real = p[first] >= 0
    first, last = first[real], last[real]
    return first, last - first + 1, p[first] - first, h100[p[first]], _mix(h400[first], h400[last])


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks: bytes, valid windows, and per byte the row and its offset in the text."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = b"".join(x for _, _, x in parts)
        valid = np.zeros(max(0, len(data) - WINDOW + 1), bool)
        starts, at = [], 0
        for _, _, x in parts:
            starts.append(at)
            valid[at : at + max(0, len(x) - WINDOW + 1)] = True
            at += len(x)
        return data, valid, np.array(starts), parts

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + 1), BLOCK):
            x = t[a : a + BLOCK + WINDOW - 1]
            if len(x) < WINDOW:
                continue
            if size and size + len(x) > 2 * BLOCK:
                yield flush()
                parts, size = [], 0
            parts.append((i, a, x))
            size += len(x)
    if parts:
        yield flush()


def _rows(docs: DataFrame) -> DataFrame:
    """Step 1: every run of windows as ``id, th, a, n, dh, m, f``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for batch in batches for x in portions(batch, "bytes", 2 << 20)):
            texts, ids, th = [bytes(x) for x in pdf["bytes"]], pdf["id"].to_numpy(), pdf["th"].to_numpy()
            for data, valid, starts, parts in _blocks(texts):
                a, n, dh, m, f = groups(data, valid)
                part = np.searchsorted(starts, a, "right") - 1
                row, off = np.array([x[0] for x in parts])[part], np.array([x[1] for x in parts])[part]
                yield pd.DataFrame({"id": ids[row], "th": th[row], "a": a - starts[part] + off, "n": n.astype(np.int32), "dh": dh.astype(np.int32), "m": m.view(np.int64), "f": f.view(np.int64)})

    return docs.mapInPandas(lean(run), "id long, th int, a long, n int, dh int, m long, f long")


def flat(*columns: str) -> Column:
    """The rows of a group in order as one array of numbers, which Python reads as such and not as records."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in columns])))
    return F.flatten(F.transform(rows, lambda x: F.array(*[x[c] for c in columns])))


def _content(active: DataFrame, docs: DataFrame) -> DataFrame:
    """Step 2: the bytes of runs that need refining."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for batch in batches for x in portions(batch, "bytes", 1 << 20)):
            out = [(i, th, a, n, dh, m, t[a : a + n - 1 + WINDOW]) for i, th, t, rs in zip(pdf["id"], pdf["th"], pdf["bytes"], pdf["runs"]) for a, n, dh, m in np.reshape(rs, (-1, 4)).tolist()]
            yield pd.DataFrame(out, columns=["id", "th", "a", "n", "dh", "m", "bytes"])

    by = active.groupBy("id", "th").agg(flat("a", "n", "dh", "m").alias("runs"))
    return docs.dropDuplicates(["id", "th"]).join(by, ["id", "th"]).mapInPandas(lean(run), "id long, th int, a long, n int, dh int, m long, bytes binary")


def _refine(content: DataFrame, width: int, nodes: bool) -> DataFrame:
    """Names for ``width`` windows at once: ``core`` of the bytes common to all of them, ``whole`` of all
    their bytes. ``lo, hi``: smallest and largest distance from window to bucket. ``nodes``: only those listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo_row in range(0, len(pdf), 500):
                part = pdf.iloc[lo_row : lo_row + 500]
                data = [bytes(x) for x in part["bytes"]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]])
                at = identifiers(b"".join(data))
                h200, h400 = at[200], at[400]
                row, lo, hi = [], [], []
                listed = part["nodes"] if nodes else [None] * len(part)
                for j, (n, dh, own) in enumerate(zip(part["n"].tolist(), part["dh"].tolist(), listed)):
                    dl = dh - n + 1
                    spans = [(max(dl, int(k) * WIDTH), min(dh, int(k) * WIDTH + WIDTH - 1)) for k in own] if nodes else [(dl, dh)]
                    for x, y in spans:
                        for k in range(x // width, y // width + 1):
                            row.append(j)
                            lo.append(max(x, k * width))
                            hi.append(min(y, k * width + width - 1))
                row, lo, hi = (np.array(x, np.int64) for x in (row, lo, hi))
                p = (starts + part["dh"].to_numpy())[row]
                whole = _mix(h400[p - hi], h400[p - lo] + _A)
                s = p - lo // width * width
                core = _mix(h200[s], h200[s + WINDOW - width + 1 - 200]) if width > 1 else whole
                got = part.iloc[row]
                yield pd.DataFrame({"id": got["id"].to_numpy(), "th": got["th"].to_numpy(), "a": got["a"].to_numpy(), "dh": got["dh"].to_numpy(), "m": got["m"].to_numpy(), "k": (lo // width).astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "core": core.view(np.int64), "whole": whole.view(np.int64)})

    return content.mapInPandas(lean(run), "id long, th int, a long, dh int, m long, k int, lo int, hi int, core long, whole long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans ``id, th, s, e`` of repeated windows (they may overlap); docs: ``id, th, bytes``."""
    same = ["m", "f", "n", "dh"]
    t1 = materialize(_rows(docs), "runs")
    classes = t1.groupBy(same).agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "a")).alias("rep"))
    classes = materialize(classes, "classes")
    shared = classes.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m")
    full = join_counted(t1, classes.where("c > 1"), same, "c", t1.count(), semi=True)
    spans = full.select("id", "th", F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + WINDOW).alias("e"))
    active = classes.join(shared, "m", "left_semi").select("rep.*", "n", "dh", "m")
    content = materialize(_content(active, docs), "content")
    nodes = materialize(_refine(content, WIDTH, False), "nodes")
    bucket, whole = ["m", "k", "core"], ["m", "k", "lo", "hi", "whole"]
    more = nodes.groupBy(bucket).agg(F.count("*").alias("c")).where("c > 1").select(bucket)
    wholes = nodes.groupBy(whole).agg(F.count("*").alias("w")).where("w > 1")
    live = materialize(nodes.join(more, bucket, "left_semi").join(wholes, whole, "left"), "live")
    span = lambda d: d.select("id", "th", (F.col("a") + F.col("dh") - F.col("hi")).alias("s"), (F.col("a") + F.col("dh") - F.col("lo") + WINDOW).alias("e"))
    spans = spans.union(span(live.where("w is not null")))
    # windows of nodes that meet but aren't equal, against all windows of their bucket
    meet = live.groupBy(bucket).agg(F.min(F.coalesce("w", F.lit(0))).alias("least")).where("least = 0").select(bucket)
    left = live.join(meet, bucket, "left_semi").groupBy("id", "th", "a", "m").agg(F.collect_set("k").alias("nodes"))
    leaves = materialize(_refine(content.join(left, ["id", "th", "a", "m"]), 1, True), "leaves")
    one = ["m", "k", "whole"]
    twice = leaves.groupBy(one).agg(F.count("*").alias("c")).where("c > 1").select(one)
    spans = spans.union(span(leaves.join(twice, one, "left_semi")))
    out = materialize(spans, "spans")
    release(t1, classes, content, nodes, live, leaves)
    return out


def folded(spans: np.ndarray) -> list[list[int]]:
    """Maximal runs of spans ``s, e, s, e, ...`` in order of their starts."""
    starts, ends = spans[::2], np.maximum.accumulate(spans[1::2])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return np.stack([starts[new], ends[np.r_[new[1:] - 1, len(ends) - 1]]], 1).tolist()


def _finish(docs: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for batch in batches for x in portions(batch, "bytes")):
            rows = []
            for i, t, ss in zip(pdf["id"], pdf["bytes"], pdf["spans"]):
                runs = folded(ss) if ss is not None else []
                cuts = [0, *(x for run in runs for x in run), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((i, len(t), sum(e - s for s, e in runs), runs, kept))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "spans", "kept"])

    # a text's spans are folded into its maximal runs before they meet the text
    w = spans.dropDuplicates().groupBy("id", "th").agg(flat("s", "e").alias("spans"))
    return docs.join(w, ["id", "th"], "left").select("id", "bytes", "spans").mapInPandas(lean(run), "id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, spans`` (maximal removed runs) and the ``kept`` bytes of every row."""
    src = keyed(docs, id_col, text_col).select("id", "th", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    return _finish(src, repeated_spans(src)).withColumn("id", F.nullif("id", F.lit(NO_ID)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
