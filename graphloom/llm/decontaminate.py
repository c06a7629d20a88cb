"""Operator 1, benchmark decontamination: template canonicalisation, in DataFrame functions only.

Numbers, names (words with one capital inside a sentence) and units (after a number) become typed
placeholders, the rest lower-case words. Windows of ``WINDOW`` tokens are hashed and joined with the
benchmark's windows. Matches are summed by item and alignment (place in the document less place in
the item); an alignment that covers ``RUN`` tokens of an item (or all, if it has fewer) is a
candidate. There the slots are compared: the same value in the item must always stand for the same
value in the document, else the template is shared and the question isn't.

Items are indexed a second time with names as plain words, and so are the windows of documents that hold names: a
document in lower case or capitals is met too, and one in which a capital after a mark looks like a name. Windows of mostly
placeholders are matched by their values, as their types alone say little. Items of fewer than ``WINDOW`` tokens are
one window, matched by its plain words and values. The benchmark's windows are broadcast only while they
number ``BROADCAST`` at most; beyond that the same join is a shuffle. Of a document only windows whose first two tokens start
a window of the benchmark are hashed and joined, while these pairs number ``STARTS`` at most; the result is the same.

Defined cases: null and empty texts match nothing, on either side; an item of one or few tokens leaks wherever these
stand in a row. Repeated rows are found by their id once; rows that share an id are found by it if one of them leaks, and
rows without an id under null; one document can hold several items. Equal alignments: the longest, then the first.
Empty tables give an empty result; a text of any length is one row of tokens; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WINDOW, RUN, BROADCAST, STARTS = 8, 13, 500_000, 20_000
#: Units that become placeholders after a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec min h hr hrs day days week weeks month months year years percent usd eur dollars dollar euros euro cents mph kmh w kw kwh v hz ghz kb mb gb tb degrees meters metres kilometers kilograms grams liters litres hours minutes seconds miles feet inches pounds".split()


_UNITS = "|".join(sorted(UNITS, key=len, reverse=True))


def surface(text: Column) -> Column:
    """Text in lower case whose slots carry type and value: ``#n3.5``, ``#umeters``, ``#pmary``."""
    t = F.regexp_replace(F.translate(text, "#", " "), r"(?<!\p{L})(\p{N}+(?:[.,]\p{N}+)*)", "#n$1")
    t = F.regexp_replace(t, rf"(?i)(#n[\p{{N}}.,]*\p{{N}}) ?({_UNITS})(?!\p{{L}})", "$1 #u$2")
    return F.lower(F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)(?!\p{L})", "#p$1"))


def tokens(surface: Column) -> Column:
    """Words and slots in order."""
    return F.regexp_extract_all(surface, F.lit(r"#n\p{N}+(?:[.,]\p{N}+)*|#?[\p{L}\p{M}]+"), F.lit(0))


def plain(token: Column) -> Column:
    """A name as a word."""
    return F.when(token.startswith("#p"), F.substr(token, F.lit(3))).otherwise(token)


def typed(token: Column) -> Column:
    """A slot as its type."""
    return F.when(token.startswith("#"), F.substring(token, 1, 2)).otherwise(token)


def places(n: Column, w: int = WINDOW) -> Column:
    """First tokens of the windows of ``n`` tokens."""
    return F.when(n >= w, F.sequence(F.lit(0), n - w)).otherwise(F.array().cast("array<int>"))


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by the tokens ``v``, their number ``n`` and hashes ``t0`` (slots as their types) and
    ``t1`` (names as words)."""
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.select(*rest, surface(F.col("text")).alias("s"))
    rows = rows.select(*rest, F.contains("s", F.lit("#p")).alias("named"), tokens(F.col("s")).alias("v"))
    rows = rows.select(*rest, "named", "v", F.size("v").alias("n"), F.transform("v", lambda x: F.xxhash64(typed(x))).alias("t0"))
    return rows.withColumn("t1", F.when(F.col("named"), F.transform("v", lambda x: F.xxhash64(typed(plain(x))))).otherwise(F.col("t0")))


def hashed(i: Column, form: int) -> Column:
    """Hash of the window at a place: its words and the types of its slots, or its values if most are slots."""
    own = F.slice("v", i + 1, WINDOW)
    own = F.transform(own, plain) if form else own
    slots = F.size(F.filter(own, lambda x: x.startswith("#")))
    return F.when(slots <= WINDOW // 2, F.xxhash64(F.slice(f"t{form}", i + 1, WINDOW))).otherwise(F.xxhash64(own, F.lit("")))


def start(i: Column, form: int) -> Column:
    """Hash of the first two tokens at a place."""
    return F.xxhash64(F.get(f"t{form}", i), F.get(f"t{form}", i + 1))


def short_hash(i: Column, w: int) -> Column:
    """Hash of a short item's window: its words and values, names as words."""
    return F.xxhash64(F.transform(F.slice("v", i + 1, w), plain), F.lit(w))


def window(i: Column, h: Column) -> Column:
    return F.struct(i.alias("pos"), h.alias("h"))


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows ``h, item, form, ipos, start`` and items ``item, form, size, itoks`` in both forms; short items in plain form only."""
    rows = prepared(items.where("text is not null").select(F.col("item_id").alias("item"), "text")).where("n > 0")
    every = lambda f: F.explode(F.transform(places(F.col("n")), lambda i: F.struct(i.alias("pos"), hashed(i, f).alias("h"), start(i, f).alias("start"))))
    all_ = [rows.select("item", F.lit(f).alias("form"), every(f).alias("w")).select("w.h", "item", "form", F.col("w.pos").alias("ipos"), "w.start") for f in (0, 1)]
    size = rows.where(F.col("n") < WINDOW)
    value = F.xxhash64(F.transform("v", plain), F.col("n"))
    short = size.select(value.alias("h"), "item", F.lit(1).alias("form"), F.lit(0).alias("ipos"), F.when(F.col("n") > 1, start(F.lit(0), 1)).alias("start"))
    whole = [rows.select("item", F.lit(f).alias("form"), F.col("n").alias("size"), (F.transform("v", plain) if f else F.col("v")).alias("itoks")) for f in (0, 1)]
    return all_[0].union(all_[1]).union(short).distinct(), whole[0].union(whole[1]).distinct()


def document_windows(src: DataFrame, sizes: list[int], starts: list[int] | None) -> DataFrame:
    """``row, doc_id, th, pos, h`` of all windows, those with names in plain form as well, and plain ones of the short
    ``sizes``. Windows whose first two tokens start none of the benchmark's (``starts``, if there are few) are left out."""
    rows = prepared(src.where("text is not null").select("doc_id", "th", F.monotonically_increasing_id().alias("row"), "text"))
    may = lambda at, form: F.filter(at, lambda i: start(i, form).isin(starts)) if starts is not None else at
    n, none = F.col("n"), F.array().cast("array<struct<pos:int,h:bigint>>")
    name = lambda i: F.exists(F.slice("v", i + 1, WINDOW), lambda x: x.startswith("#p"))
    named = F.when(F.col("named"), F.transform(F.filter(may(places(n), 1), name), lambda i: window(i, hashed(i, 1)))).otherwise(none)
    all_ = [F.transform(may(places(n), 0), lambda i: window(i, hashed(i, 0))), named]
    whole = lambda w: F.transform(may(places(n, w), 1) if w > 1 else places(n, w), lambda i: window(i, short_hash(i, w)))
    all_ += [whole(w) for w in sizes]
    return rows.select("row", "doc_id", "th", F.explode(F.concat(*all_)).alias("w")).select("row", "doc_id", "th", "w.pos", "w.h")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, first_token, n_tokens, n_slots, changed``: the best alignment of each item that leaked."""
    windows, whole = benchmark_windows(items)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    small = windows.count() <= BROADCAST
    near = F.broadcast if small else (lambda d: d)
    sizes = sorted(r[0] for r in whole.where((F.col("size") < WINDOW) & (F.col("form") == 1)).select("size").distinct().collect())
    starts = [r[0] for r in windows.select("start").where("start is not null").distinct().limit(STARTS + 1).collect()]
    rows = document_windows(src, sizes, starts if len(starts) <= STARTS else None)
    met = rows.join(near(windows.drop("start")), "h").groupBy("row", "doc_id", "th", "item", "form", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.count("*").alias("n"))
    met = met.join(near(whole), ["item", "form"]).where(F.col("n") + F.least(F.lit(WINDOW), F.col("size")) - 1 >= F.least(F.lit(RUN), F.col("size")))
    met = met.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), "item", "form", "shift", "n", "itoks").distinct()
    # a text that holds the items of an alignment is cut once, into the tokens beside the item
    full = met.join(src, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")))
    lead = F.greatest(-F.col("shift"), F.lit(0))  # tokens of the item before the text's first
    beside = F.slice(tokens(surface(F.col("text"))), F.greatest("shift", F.lit(0)) + 1, F.size("itoks") - lead)
    beside = F.concat(F.array_repeat(F.lit(None).cast("string"), lead), beside)
    full = full.select("doc_id", "item", "form", "shift", "n", "itoks", beside.alias("own")).distinct()
    full = materialize(full, "aligned")  # else the tokens would be cut anew for every place compared
    own = F.when(F.col("form") == 1, F.transform("own", plain)).otherwise(F.col("own"))
    pair = F.arrays_zip(F.col("itoks").alias("a"), own.alias("b"))
    slot = lambda x: F.substring(x, 1, 2)
    pairs = F.filter(pair, lambda p: p["a"].startswith("#") & F.coalesce(p["b"].startswith("#"), F.lit(False)) & (slot(p["a"]) == slot(p["b"])))
    full = full.withColumn("pairs", F.array_distinct(pairs))
    one = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    good = full.where(F.size("pairs") == one)
    n = (F.col("n") + F.least(F.lit(WINDOW), F.size("itoks")) - 1).cast("long")
    row = good.select("doc_id", F.col("item").alias("item_id"), F.greatest("shift", F.lit(0)).cast("long").alias("first_token"), n.alias("n_tokens"), F.size("pairs").cast("long").alias("n_slots"), F.exists("pairs", lambda p: p["a"] != p["b"]).alias("changed"))
    best = row.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("first_token", "n_tokens", "n_slots", "changed"), F.struct("n_tokens", -F.col("first_token"), "n_slots", ~F.col("changed"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""
    bad = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
