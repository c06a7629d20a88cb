"""Operator 10, language ID: multilingual mixture inference.

A character-trigram model per language is counted on labelled documents. A document is a mixture of
languages: expectation-maximisation estimates the proportions that make its trigrams likeliest, and a
set of languages is chosen by likelihood less a penalty of half the logarithm of the number of
trigrams for each further language. The prediction is the largest share in the chosen set.

Only the number of training documents is bounded: ``per_lang`` documents of each language, chosen by
a hash of the id (fewer, if there are fewer). Every label is learned, and the ``grams`` commonest trigrams of each,
of whatever characters. The model is the size of the label set times ``grams``.

Defined cases: null text and text without a letter (``\\p{L}``) is ``und`` with score 0; text with letters none of
whose trigrams is known gets the commonest language with score 0; without training rows all is
``und``. Rows are independent: ties go to the language first in order, repeated rows get the same
answer, whether they have an id or not; other columns (lang, source) are not read for a prediction and not
moved; a very long text is one count of trigrams.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KeyTable, lean

PER_LANG, GRAMS = 1500, 4000
#: Word characters that are neither letters nor digits to ``re``, such as fractions and Roman numerals.
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L")
NUMERALS = [re.compile("[" + "".join(c for c in NUMERALS if (c > "\uffff") == far) + "]") for far in (False, True)]  # one table is faster than both
FAR, LETTERS = re.compile("[\U00010000-\U0010ffff]"), re.compile(r"[^\W\d_]+")


def words(text: str) -> str:
    """Letters in lower case, each word between single blanks."""
    low = text.lower()
    if not low.isascii():
        low = NUMERALS[0].sub(" ", low)
        if FAR.search(low):
            low = NUMERALS[1].sub(" ", low)
    return " " + " ".join(LETTERS.findall(low)) + " "


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_lang: int = PER_LANG, grams: int = GRAMS) -> dict:
    """The model, from rows with ``doc_id, text, lang``: counted on executors, collected by a fixed bound."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {"langs": []}
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_lang / n))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for text, lang in zip(pdf["text"], pdf["lang"]):
                w = words(text)
                found.update((lang, w[i : i + 3]) for i in range(len(w) - 2))
            yield pd.DataFrame([(k, g, n) for (k, g), n in found.items()], columns=["lang", "gram", "n"])

    counted = sample.mapInPandas(lean(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams)
    counts = {(r["lang"], r["gram"]): r["n"] for r in top.collect()}
    langs = sorted({k for k, _ in counts})
    known = sorted({g for _, g in counts})
    n = np.array([[counts.get((k, g), 0) for k in langs] for g in known], float).reshape(len(known), len(langs))
    return {"langs": langs, "grams": known, "p": (n + 0.5) / (n.sum(0) + 0.5 * len(known)), "main": max(sorted(totals), key=totals.get)}


class Mixture:
    """Predictions of one model."""

    def __init__(self, model: dict):
        self.langs, self.main, self.p = model["langs"], model["main"], model["p"]
        self.log_p, grams = np.log(self.p), model["grams"]
        self.table = KeyTable(4 * len(grams))
        self.table.add(self.keys("".join(grams))[::3], np.arange(len(grams), dtype=np.int32))

    @staticmethod
    def keys(text: str) -> np.ndarray:
        """A number for each three characters in a row."""
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]

    def em(self, p: np.ndarray, c: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
        total = c.sum()
        for _ in range(30):
            new = pi * ((c / (p @ pi)) @ p) / total
            moved, pi = np.abs(new - pi).max(), new
            if moved < 1e-3:
                break
        return pi, float(c @ np.log(p @ pi))

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Language, its share, and the shares of the chosen set."""
        w = words(text or "")
        if len(w) < 3:
            return "und", 0.0, {}
        counts = np.bincount(self.table.find(self.keys(w), len(self.p)), minlength=len(self.p))[: len(self.p)]
        at = np.flatnonzero(counts)
        if not len(at):
            return self.main, 0.0, {self.main: 0.0}
        c, p = counts[at].astype(float), self.p[at]
        single = c @ self.log_p[at]
        chosen = [int(single.argmax())]
        best, shares = float(single.max()), np.ones(1)
        pi, ll = self.em(p, c, np.full(len(self.langs), 1 / len(self.langs)))
        penalty = 0.5 * math.log(c.sum() + 1)
        if ll - best > penalty:
            while len(chosen) < len(self.langs):
                tried = []
                for k in range(len(self.langs)):
                    if k not in chosen and pi[k] > 0.02:
                        q, new = self.em(p[:, [*chosen, k]], c, np.full(len(chosen) + 1, 1 / (len(chosen) + 1)))
                        tried.append((new, -k, q))
                if not tried or (top := max(tried, key=lambda t: t[:2]))[0] - best <= penalty:
                    break
                best, shares = top[0], top[2]
                chosen.append(-top[1])
        k = int(shares.argmax())
        mine = {self.langs[j]: float(s) for j, s in zip(chosen, shares)}
        return self.langs[chosen[k]], float(min(1.0, max(0.0, shares[k] if len(chosen) > 1 else pi[chosen[0]]))), mine


def predicted(model: dict) -> Callable[[Column], Column]:
    """Column function: ``struct<lang_pred, score, shares>`` of a text (shares: map of the chosen set)."""
    held: list[Mixture] = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held and model["langs"]:
            held.append(Mixture(model))
        for texts in batches:
            out = [held[0].predict(t) if held else ("und", 0.0, {}) for t in texts]
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "shares": [x[2] for x in out]})

    def lean_run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(run)(batches)

    return F.pandas_udf(lean_run, "lang_pred string, score double, shares map<string,double>")


def identify(docs: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score, shares`` (map of the chosen set) for every row."""
    got = predicted(model)(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), got.alias("p")).select("doc_id", "p.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: rejects documents in which no language is found (``und``)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(fit(docs))(F.col("text")).alias("p"))
    return own.where(F.col("p.lang_pred") != "und").select("row.*")
