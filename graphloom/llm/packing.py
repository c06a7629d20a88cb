"""Operator 6, best-fit packing: bounded-space online best-fit into fixed-length sequences.

Documents become token pieces of at most ``capacity``; only longer documents are cut, with a short
piece first and whole sequences after it. Pieces are dealt by hash into groups of about ``GROUP``;
each group streams them through a packer that keeps at most ``OPEN`` open bins and reads ``AHEAD`` pieces ahead,
which it places longest first. The free spaces of the open bins are the bits of one integer, so the tightest bin
that fits is the lowest set bit above the piece's length; when all bins are taken the fullest closes first. A
group is deterministic in its rows, so a lost executor repeats it with the same result. Only lengths are
dealt; the pieces' ids, if asked for, meet their places by a join.

Token ids come from the ranks form of the vocabulary, which gives the same ids as its JSON form in a fifth of the
time; texts with very long runs of white space, which it can't take, go to the JSON form.

Defined cases: null text is empty and packs its end token alone; repeated rows are packed as often as
they come, and so are rows without an id or with the same id; pieces of equal length are taken in the order of
their numbers; an empty table gives no pieces; a text of any length is encoded in one piece; columns other than
id and text are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, portions

GROUP, AHEAD, OPEN = 200_000, 2048, 1024
RUN = re.compile(r"\s{2000}")


@lru_cache(2)
def encoder(ranks_path: str, pattern: str):
    """Same ids as the JSON form of the vocabulary gives; the ranks form is four times as fast."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(1)
def whole_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, ranks_path: str, pattern: str, json_path: str) -> list[int]:
    text = text or ""
    if RUN.search(text):
        return whole_encoder(json_path).encode(text, add_special_tokens=False).ids
    return encoder(ranks_path, pattern).encode(text, allowed_special="all")


class Packer:
    """Online best-fit with at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int = OPEN):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _put(self, free: int, bin_id: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_id)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fits = self.bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id, self.next = self.capacity, self.next, self.next + 1
        self._put(free - length, bin_id)
        return bin_id, self.capacity - free


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ids themselves (little-endian 32 bits each;
    bytes stay compact on their way through Python, which lists of numbers don't). ``vocabulary``: ranks file, its
    pattern, JSON file. Ids travel as text, so that large numbers beside nulls stay exact."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for batch in batches for x in portions(batch, "text", 1 << 20)):
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*token_ids(text, *vocabulary), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[a:b].tobytes()
                    rows.append((doc, k, a, b - a, zlib.crc32(own), *([own] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(lean(run), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = 1024, with_ids: bool = False, open_bins: int = OPEN, **columns: str) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; each sequence is gapless from 0."""
    cut = pieces(docs, vocabulary, capacity, with_ids=with_ids, **columns)
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")  # fixed once written
    groups = max(1, -(-cut.count() // GROUP))
    deal = F.xxhash64("uid")
    dealt = cut.select("uid", "length").repartition(groups, deal).sortWithinPartitions(deal, "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40

        def place(some: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values("length", ascending=False, kind="stable")
            at = [packer.add(n) for n in some["length"].tolist()]
            return pd.DataFrame({"uid": some["uid"], "sequence_id": np.array([base + b for b, _ in at], np.int64), "offset": np.array([o for _, o in at], np.int64)})

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            full = len(held) // AHEAD * AHEAD
            for a in range(0, full, AHEAD):
                yield place(held.iloc[a : a + AHEAD])
            held = held.iloc[full:]
        if held is not None and len(held):
            yield place(held)

    placed = dealt.mapInPandas(lean(run), "uid long, sequence_id long, offset long")
    return cut.join(placed, "uid").drop("uid")


def vocabulary() -> tuple[str, str, str]:
    """The public byte-level vocabulary: ranks file, pattern, JSON file."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the last stage; all that is left is packed, with the pieces' ids."""
    return pack(docs, vocabulary(), with_ids=True)
