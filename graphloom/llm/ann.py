"""Operator 4, nearest neighbours by inner product: score-aware anisotropic quantisation.

A product quantiser with 16 centroids for every two dimensions (four bits) is trained on a sample of at
most ``SAMPLE`` vectors. Its loss weighs the residual parallel to the vector ``eta`` times as much as the
rest, since that is what shifts large inner products; both the assignment (coordinate descent over the
subspaces) and the centroids (a linear system each) minimise it. Every vector is indexed: codes are
packed two to a byte, in blocks of ``BLOCK`` vectors. Queries come in blocks of ``QUERIES`` and meet every block of
the index, which is dealt into shards; a task has one query block and the index blocks of a shard, one after the other.
A block is scanned with 256-entry tables (two subspaces at once), the ``RERANK`` best by
estimate are scored exactly in double precision, and only the ``k`` best so far are kept. Index blocks travel once
for each query block, vectors in the type that they came in.

Equal vectors: only the k + 1 smallest ids of each can be among k nearest with ties to the smaller id
(one may be the query itself), so the rest aren't scanned; the limit is taken before rows are dealt.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part. Vectors of different lengths have no inner product: each length is a search of its own. Repeated rows (same id and
vector) are one; rows that share an id are candidates each, and ask with the smallest of their vectors. Ties
go to the smaller id. With fewer than k candidates all are returned; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize

SAMPLE, BLOCK, QUERIES, SHARDS, RERANK, THRESHOLD = 8192, 2048, 8192, 4, 200, 0.2


class Quantizer:
    """Anisotropic product quantiser: ``books[m, c]`` are the centroids of subspace m."""

    def __init__(self, dim: int):
        self.dim, self.m = dim, -(-dim // 4) * 2  # pairs of dimensions, an even number of them
        self.eta = (max(dim, 2) - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.m * 2))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.m, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss, one subspace after another."""
        x = self.split(x)
        weight = (max(self.eta, 1.0) - 1) / np.maximum((x**2).sum((1, 2)), 1e-30)
        codes = np.stack([((x[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.m)], 1)
        picked = lambda m: self.books[m][codes[:, m]]
        par = np.stack([((x[:, m] - picked(m)) * x[:, m]).sum(1) for m in range(self.m)], 1)
        total = par.sum(1)
        for _ in range(sweeps):
            for m in range(self.m):
                diff = x[:, m, None] - self.books[m]
                own = (diff * x[:, m, None]).sum(2)
                rest = (total - par[:, m])[:, None]
                codes[:, m] = ((diff**2).sum(2) + weight[:, None] * (rest + own) ** 2).argmin(1)
                new = own[np.arange(len(x)), codes[:, m]]
                total, par[:, m] = total - par[:, m] + new, new
        return codes.astype(np.uint8)

    def fit(self, sample: np.ndarray, rounds: int = 6) -> Quantizer:
        x = self.split(sample)
        rng = np.random.default_rng(0)
        pick = np.resize(rng.permutation(len(x)), 16)
        self.books = x[pick].transpose(1, 0, 2).copy()
        for _ in range(4):  # plain k-means to start from
            for m in range(self.m):
                c = ((x[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
                for k in range(16):
                    if (c == k).any():
                        self.books[m, k] = x[c == k, m].mean(0)
        weight = (max(self.eta, 1.0) - 1) / np.maximum((x**2).sum((1, 2)), 1e-30)
        for _ in range(rounds):
            codes = self.encode(sample, 1)
            approx = np.stack([self.books[m][codes[:, m]] for m in range(self.m)], 1)
            par = ((x - approx) * x).sum(2)
            for m in range(self.m):
                s = par.sum(1) - par[:, m] + (x[:, m] ** 2).sum(1)
                for k in range(16):
                    at = codes[:, m] == k
                    if at.any():
                        y, w = x[at, m], weight[at]
                        a = at.sum() * np.eye(2) + (w[:, None] * y).T @ y
                        self.books[m, k] = np.linalg.solve(a, y.sum(0) + ((w * s[at])[:, None] * y).sum(0))
                par[:, m] = ((x[:, m] - self.books[m][codes[:, m]]) * x[:, m]).sum(1)
        return self

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial scores of each byte value: queries x bytes x 256."""
        part = np.einsum("qmd,mcd->qmc", self.split(queries), self.books)
        both = part[:, 0::2, :, None] + part[:, 1::2, None, :]
        return both.reshape(len(queries), self.m // 2, 256).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def valid(vec: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _blocks(vecs: DataFrame, size: int, kind: type, quantizer: Quantizer | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                x = np.stack(part["vec"].to_list()).astype(np.float64)
                codes = pack(quantizer.encode(x)).tobytes() if quantizer else b""
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "codes": [codes], "vecs": [x.astype(kind).tobytes()], "first": [part["id"].iloc[0]]})

    return vecs.mapInPandas(lean(run), "ids binary, codes binary, vecs binary, first long")


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest of every row for which ``queries`` holds."""
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    real = vectors.where(valid(F.col(vec_col)))
    rows = real.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), queries.alias("asks")).where("id is not null")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    found = [_search(rows.where(F.size("vec") == dim), sizes[dim], dim, kind, k) for dim in sorted(sizes)]
    out = found[0] if found else vectors.sparkSession.createDataFrame([], SCHEMA)
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search(rows: DataFrame, n: int, dim: int, kind: type, k: int) -> DataFrame:
    """The search among ``n`` vectors of one length."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / n)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).select("vec").limit(2 * SAMPLE).collect()
    some = some or rows.select("vec").limit(SAMPLE).collect()
    quantizer = Quantizer(dim).fit(np.array([r["vec"] for r in some]))
    alike = Window.partitionBy(F.xxhash64("vec"), F.hash("vec")).orderBy("id")
    few = rows.groupBy("id", "vec").agg(F.max("asks").alias("asks"))
    few = few.select("id", "vec", F.row_number().over(alike).alias("r")).where(F.col("r") <= k + 1)
    full = max(1, -(-n // (4 * BLOCK)))  # fewer partitions, so that blocks are full
    index = materialize(_blocks(few.select("id", "vec").coalesce(full), BLOCK, kind, quantizer), "index")
    asked = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec")).coalesce(max(1, n // 400_000))
    asked = materialize(_blocks(asked, QUERIES, kind, None), "queries")
    asks = asked.count()
    if not asks:
        return spark.createDataFrame([], SCHEMA)
    shards = max(1, min(index.count(), max(SHARDS, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // asks))))
    number = asked.select("first", (F.row_number().over(Window.orderBy("first")) - 1).alias("ask"))  # a row for each query block
    q = asked.join(F.broadcast(number), "first").select("ask", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("tag"), "ids", "codes", "vecs")
    i = index.select(F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"), F.pmod(F.xxhash64("first", "ids"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("tag"), "ids", "codes", "vecs")
    met = q.unionByName(i).repartition(min(100_000, asks * shards), "ask", "shard").sortWithinPartitions("ask", "shard", "tag")

    def scan(ids: np.ndarray, codes: np.ndarray, vecs: np.ndarray, qi: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best of a block, for some queries."""
        tables, scores = quantizer.tables(qv), np.zeros((len(qi), len(ids)), np.float32)
        for b, col in enumerate(codes):
            scores += tables[:, b].take(col, 1)
        r = min(RERANK, len(ids))
        near = np.argpartition(scores, len(ids) - r, 1)[:, -r:] if r < len(ids) else np.tile(np.arange(len(ids)), (len(qi), 1))
        exact = np.einsum("qrd,qd->qr", vecs[near].astype(np.float64), qv)
        return ids[near], np.where(ids[near] == qi[:, None], -np.inf, exact)

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores), 1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the queries in hand and their best so far

        def flush() -> pd.DataFrame:
            q, _, i, x = held
            real = x > -np.inf
            return pd.DataFrame({"query_id": np.repeat(q, i.shape[1])[real.ravel()], "vec_id": i[real], "score": x[real]})

        for pdf in batches:
            for tag, ids, codes, vecs in zip(pdf["tag"], pdf["ids"], pdf["codes"], pdf["vecs"]):
                ids, vecs = np.frombuffer(ids, np.int64), np.frombuffer(vecs, kind).reshape(-1, dim)
                if tag == 0:
                    if held:
                        yield flush()
                    held = (ids, vecs.astype(np.float64), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0)))
                    continue
                codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(len(ids), -1).T)
                qi, qv, known, scores = held
                parts = [scan(ids, codes, vecs, qi[a : a + 64], qv[a : a + 64]) for a in range(0, len(qi), 64)]
                held = (qi, qv, *best(*(np.concatenate([old, np.concatenate([x[j] for x in parts])], 1) for j, old in enumerate((known, scores)))))
        if held:
            yield flush()

    found = met.select("tag", "ids", "codes", "vecs").mapInPandas(lean(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
