"""Helpers shared by the operators: tables in the shared folder, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FEW, NO_ID = 1000, (1 << 63) - 1  # most heavy keys; in place of a missing id, after all others
SALT, MANY, FULL = 2048, 500, 32  # rows of a block; buckets with more rows are compared by close rows first; and list their keys


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a local one only for local masters."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables written by :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_shared_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            del t._shared_path
    gc.collect()  # shuffle files of finished steps go once nothing refers to them
    SparkSession.active()._jvm.System.gc()


@lru_cache(1)
def _malloc():
    """The C library's allocator, told to give arrays of 256 KB and more back when they are freed, not to keep them for
    later; None where there is no such library."""
    import ctypes

    import pyarrow as pa

    try:
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, which else grows with what is freed
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    except (OSError, AttributeError):
        return None
    return libc


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches whose worker, which Spark keeps for later tasks, holds little memory between them."""

    def held(batches: Iterator) -> Iterator:
        libc = _malloc()
        yield from run(batches)
        if libc:
            libc.malloc_trim(0)

    return held


def slices(sizes: Sequence[int], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``; a larger item stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def portions(pdf, column: str, limit: int = 4 << 20):
    """The rows of a pandas batch in portions whose ``column`` holds about ``limit`` bytes."""
    for a, b in slices([len(x) if x is not None else 0 for x in pdf[column]], limit):
        yield pdf.iloc[a:b]


def join_counted(rows: DataFrame, found: DataFrame, on: list[str], count: str, total: int, semi: bool = False) -> DataFrame:
    """``rows`` joined with ``found``, which has each key once and the number of its rows in ``count``. The keys of many
    rows, ``FEW`` at most, are joined by broadcast, so that none of them is one task's."""
    often = max(FEW, -(-total // FEW))
    heavy, light = F.broadcast(found.where(F.col(count) >= often)), found.where(F.col(count) < often)
    if semi:
        heavy, light = heavy.select(on), light.select(on)
    how = "left_semi" if semi else "inner"
    return rows.join(heavy, on, how).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on, how))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, text``: rows without an id get ``NO_ID``, rows that share one differ by their texts' hash."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("th"), text.alias("text"))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(id, comp)`` with comp the smallest id reachable.

    Every round each vertex hooks to the neighbour of smallest hash and the graph is contracted, so
    the number of rounds is logarithmic in the longest path whatever order the ids have. Labels are made from the
    last round back to the first, so a round's vertices get theirs once and not again in every later round. Self-loops
    are ignored; vertices without an edge aren't listed. No step gathers a component in one task.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    tidy = lambda d: (
        d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    e, hooks = materialize(tidy(edges.select("a", "b")), f"{tag}-edges"), []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        best = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        hook = materialize(best.select("u", F.least(order("u"), F.col("m"))["id"].alias("r")), f"{tag}-hook")
        ra, rb = (hook.select(F.col("u").alias(c), F.col("r").alias(f"r{c}")) for c in "ab")
        e2 = e.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        e2 = materialize(tidy(e2), f"{tag}-edges")
        release(e)
        hooks.append(hook)
        e = e2
    release(e)
    if not hooks:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).limit(0)
    labels = hooks.pop()
    while hooks:  # from the last round, which has fewest vertices, to the first
        hook, nxt = hooks.pop(), labels.select(F.col("u").alias("r"), F.col("r").alias("s"))
        new = materialize(hook.join(nxt, "r", "left").select("u", F.coalesce("s", "r").alias("r")), f"{tag}-labels")
        release(labels, hook)
        labels = new
    roots = labels.groupBy("r").agg(F.min("u").alias("comp"))
    return materialize(labels.join(roots, "r").select(F.col("u").alias("id"), "comp"), f"{tag}-comp")


def meet(buckets: DataFrame, tag: str) -> DataFrame:
    """The buckets ``key, id`` (and ``t``, traits, if there) that hold several rows, with their number ``m`` and their
    smallest row ``a`` (and its traits ``ta``)."""
    first = F.min(F.struct("id", "t")) if "t" in buckets.columns else F.min(F.struct("id"))
    pivots = buckets.groupBy("key").agg(first.alias("p"), F.count("*").alias("m")).where("m > 1")
    named = [F.col("p.id").alias("a"), *([F.col("p.t").alias("ta")] if "t" in buckets.columns else [])]
    pivots = materialize(pivots.select("key", "m", *named), f"{tag}-pivots")  # few rows share a bucket; as a table its size is known to the join
    out = materialize(buckets.join(pivots, "key"), f"{tag}-shared")
    release(pivots)
    return out


def linked(shared: DataFrame, traits: DataFrame, near: Callable[[Column, Column], Column], check: Callable[[DataFrame], DataFrame], tag: str, close: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Components ``(id, comp)`` under the links that ``check`` confirms among rows sharing a bucket.

    ``shared``: from :func:`meet`; ``traits``: ``id, t`` with what ``near`` needs to tell of two rows whether
    they may be linked (if they are small, ``shared`` carries them with every row); ``check`` gets pairs ``a < b`` and
    returns those that hold. A bucket of n rows makes n - 1 pairs with its smallest row. Of buckets of many rows that then
    still span several components, rows of different ones that are ``close``, and so very likely linked, are compared
    next, which joins most of a group of near copies. Then members of different components
    are compared, by ``near`` within the join, so no pair that could join two components is left out
    and a group of copies never makes all its pairs. Large buckets are cut into blocks
    of about ``SALT`` rows, and pairs of blocks are joined, so no task has a whole bucket's comparisons; a pair that
    several buckets of more than ``FULL`` rows have comes from that of smallest key only (if ``shared`` carries traits).
    """
    own, carry = shared, "t" in shared.columns
    side = lambda c: traits.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"))

    def likely(pairs: DataFrame, ends: str) -> DataFrame:
        """Pairs ``a, b`` that may be linked; of the ends in ``ends`` the traits aren't there yet."""
        for c in ends:
            pairs = pairs.join(side(c), c)
        return pairs.where(near(F.col("ta"), F.col("tb"))).select("a", "b").distinct()

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    rows = own.where("a < id")
    if carry:  # of the smallest rows of its buckets that a row may be linked to, it meets the smallest; the rest is found below
        pairs = rows.where(near(F.col("ta"), F.col("t"))).groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    else:
        pairs = likely(rows.select("a", F.col("id").alias("b")).distinct(), "ba")
    links = materialize(check(pairs), f"{tag}-links")
    comp = components(links, tag)
    mixed = _mixed((own if carry else own.where("m > 2")).drop("a", "ta"), comp, tag)
    compare = lambda rows, how: materialize(check(_across(rows, how).select(*ordered("ia", "ib")).distinct()), f"{tag}-links")
    if close and carry and not (large := mixed.where(F.col("size") > MANY)).isEmpty():  # the other buckets wait as they are
        rest = _listed(large, tag)
        comp = _merged(comp, compare(rest, close), tag)
        release(rest)
        before, left = mixed, _mixed(large.drop("comp", "size"), comp, tag)
        mixed = materialize(mixed.where(F.col("size") <= MANY).unionByName(left), f"{tag}-mixed")
        release(before, left)
    rest = _listed(mixed, tag) if carry else materialize(mixed.join(traits, "id"), f"{tag}-traits").withColumn("ks", F.lit(None).cast("array<long>"))
    comp = _merged(comp, compare(rest, near), tag)
    release(rest, mixed, shared, links)
    return comp


def _listed(rows: DataFrame, tag: str) -> DataFrame:
    """Rows of buckets with ``ks``: the keys of all larger buckets that the row is in, null in a small one."""
    full = rows.where(F.col("size") > FULL)
    lists = full.groupBy("id").agg(F.collect_list("key").alias("ks"))
    small = rows.where(F.col("size") <= FULL).withColumn("ks", F.lit(None).cast("array<long>"))
    return materialize(full.join(lists, "id").unionByName(small), f"{tag}-listed")


def dealt(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows of buckets (``key``, of ``m`` rows) with their block ``blk``, once for every pair ``p <= q`` of blocks that theirs is in."""
    last = F.ceil(F.col("m") / SALT).cast("int") - 1
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(id_col), last + 1).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.least(i, "blk").alias("p"), F.greatest(i, "blk").alias("q")))
    return rows.select("*", F.inline(pairs)).drop("m")


def _across(rows: DataFrame, near: Callable) -> DataFrame:
    """Pairs ``ia, ib`` of rows of a bucket that lie in different components and are ``near``; a ``near`` of one
    argument compares the rows itself, dealt by pairs of blocks."""
    if near.__code__.co_argcount == 1:
        return near(dealt(rows, "cid"))
    blocks = F.ceil(F.col("m") / SALT).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    x = rows.select("key", F.col("blk").alias("p"), F.explode(F.sequence("blk", blocks - 1)).alias("q"), F.col("id").alias("ia"), F.col("comp").alias("ca"), F.col("t").alias("ta"), F.col("ks").alias("ka"))
    y = rows.select("key", F.explode(F.sequence(F.lit(0), "blk")).alias("p"), F.col("blk").alias("q"), F.col("id").alias("ib"), F.col("comp").alias("cb"), F.col("t").alias("tb"), F.col("ks").alias("kb"))
    once = F.col("ka").isNull() | (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))
    return x.join(y, ["key", "p", "q"]).where(((F.col("p") < F.col("q")) | (F.col("ia") < F.col("ib"))) & (F.col("ca") != F.col("cb")) & near(F.col("ta"), F.col("tb")) & once)


def _mixed(rows: DataFrame, comp: DataFrame, tag: str) -> DataFrame:
    """The rows of buckets that span several components, with their ``comp`` and their bucket's ``size``."""
    label = materialize(rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")), f"{tag}-bucket")
    keys = label.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    out = materialize(label.join(keys.select("key", "size"), "key"), f"{tag}-mixed")
    release(label)
    return out


def _merged(comp: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Components after further links: only the components that these join are walked."""
    if links.isEmpty():
        release(links)
        return comp
    known = comp.select(F.col("id").alias("v"), "comp")
    ends = links.join(known.alias("x"), F.col("a") == F.col("x.v"), "left").join(known.alias("y"), F.col("b") == F.col("y.v"), "left")
    merged = components(ends.select(F.coalesce("x.comp", "a").alias("a"), F.coalesce("y.comp", "b").alias("b")), tag)
    new = comp.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = materialize(new.unionByName(merged.join(comp.select("id"), "id", "left_anti")), f"{tag}-merged")
    release(comp, merged, links)
    return out


class KeyTable:
    """Open hash table from 64-bit keys (0 excluded) to numbers, read and filled by arrays of keys."""

    def __init__(self, most: int):
        self.bits = int(2 * most).bit_length()
        self.keys, self.to = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or of the empty place where it belongs."""
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        away = np.flatnonzero((there != keys) & (there != 0))
        while len(away):
            at[away] = (at[away] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[away]]
            away = away[(there != keys[away]) & (there != 0)]
        return at

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New keys, each once."""
        while len(keys):
            at = self.places(keys)
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            done = self.keys[at] == keys
            self.to[at[done]] = numbers[done]
            keys, numbers = keys[~done], numbers[~done]

    def find(self, keys: np.ndarray, lack: int) -> np.ndarray:
        at = self.places(keys)
        return np.where(self.keys[at] == 0, lack, self.to[at])
