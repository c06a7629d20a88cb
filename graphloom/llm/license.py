"""Operator 3, licence scan: a positional rare-token index, in DataFrame functions only.

Templates are word sequences with a label and a mandatory key phrase. The corpus gives each template
word its document frequency; the two words of highest IDF of a template are its anchors, and its
postings are (anchor, position in the template). In a file every anchor word is looked up; a posting
puts the template's start at word position minus posting position, and only starts on which both
anchors agree go on. There the key phrase must stand word by word; the share of the template's IDF
that stands at its places is the score. A true place holds all its words, so no place is lost.

Texts are cut once: a number for each word, 0 but for template words, is written to the shared folder as the index, so a
word at a place is found at once and time grows with the text, however long and however often it holds anchors.
What reaches the driver is a count for each template word, a fixed list; only those counts are shuffled.

Defined cases: null text is empty: no words, no labels (empty strings), null positions, score 0.
Rows are independent: repeated rows, and rows without an id or with the same one, each get their answer; overlapping
places all count; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: label, template, mandatory key phrase (a part of the template), base phrase or not
TEMPLATES = [
    ("cc-by", "cc by", "cc by", True),
    ("gpl", "general public license", "general public license", True),
    ("reserved", "all rights reserved", "all rights reserved", True),
    ("cc-by-nc", "cc by nc", "cc by nc", False),
    ("cc-by-sa", "cc by sa", "cc by sa", False),
    ("cc0", "creative commons zero", "creative commons zero", False),
    ("lgpl", "lesser general public license", "lesser general public license", False),
    ("agpl", "affero general public license", "affero general public license", False),
    ("apache", "licensed under the apache license version 2 0", "apache license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", False),
    ("mpl", "mozilla public license", "mozilla public license", False),
    ("public-domain", "released into the public domain", "public domain", False),
    ("licensed", "licensed under", "licensed under", False),
]
SHARE = 0.6  # of a template's IDF that must stand for its label


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def occurrences(docs: DataFrame, vocab: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index, written once: ``doc_id, n_words, codes``; a code is a word's place in ``vocab`` from 1, or 0."""
    known = F.array(*map(F.lit, vocab))
    code = lambda w: F.when(w.isin(vocab), F.array_position(known, w)).otherwise(F.lit(0)).cast("tinyint" if len(vocab) < 128 else "int")
    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.transform(words_of(F.col(f"`{text_col}`")), code).alias("codes"))
    return materialize(cut.select("doc_id", F.size("codes").cast("long").alias("n_words"), "codes"), "licence-words")


def frequencies(found: DataFrame, vocab: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and documents in all (under code 0)."""
    own = F.array_distinct(F.concat(F.filter("codes", lambda c: c > 0), F.array(F.lit(0).cast(found.schema["codes"].dataType.elementType))))
    n = {r["c"]: r["n"] for r in found.select(F.explode(own).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    return {w: n.get(k + 1, 0) for k, w in enumerate(vocab)}, n.get(0, 0)


def index(df: dict[str, int], n: int, templates: list[tuple] = TEMPLATES) -> list[dict]:
    """Templates with their anchors: the two words of highest IDF, the earlier on a tie."""
    out = []
    for label, text, key, base in templates:
        words, phrase = text.split(), key.split()
        idf = [math.log((n + 1) / (df[w] + 1)) + 1 for w in words]
        a, b = (sorted(range(len(words)), key=lambda i: (-idf[i], i)) * 2)[:2]
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append({"label": label, "words": words, "weights": [x / sum(idf) for x in idf], "key": key, "key_at": at, "key_len": len(phrase), "a": words[a], "a_at": a, "b": words[b], "b_at": b, "base": base})
    return out


def _literal(t: dict) -> Column:
    lit = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in t.items()}
    return F.struct(*[v.alias(k) for k, v in lit.items()])


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places``; a place has ``label, start, score, base, found``."""
    vocab = sorted({w for _, t, _, _ in templates for w in t.split()})
    occ = occurrences(docs, vocab, id_col, text_col)
    code = {w: k + 1 for k, w in enumerate(vocab)}
    coded = lambda v: [code[x] for x in v] if isinstance(v, list) else code[v]
    built = [t | {k: coded(t[k]) for k in ("words", "a", "b")} for t in index(*frequencies(occ, vocab), templates)]
    anchors = sorted({t["a"] for t in built})
    at = lambda p: F.when(p >= 0, F.get("codes", p.cast("int")))

    def place(t: Column, start: Column) -> Column:
        got = F.transform(t["words"], lambda w, j: F.coalesce(at(start + j) == w, F.lit(False)))
        score = F.aggregate(F.zip_with(got, t["weights"], lambda g, v: F.when(g, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
        key = F.forall(F.slice(got, t["key_at"] + 1, t["key_len"]), lambda g: g)
        score = F.when(F.abs(score - 1) < 1e-9, F.lit(1.0)).otherwise(score)
        return F.struct(t["label"].alias("label"), start.alias("start"), score.alias("score"), t["base"].alias("base"), (key & (score >= SHARE)).alias("found"))

    posting = F.array(*map(_literal, built))
    agreed = lambda p, w: F.filter(posting, lambda t: (t["a"] == w) & (p >= t["a_at"]) & F.coalesce(at(p - t["a_at"] + t["b_at"]) == t["b"], F.lit(False)))
    every = F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.size("codes") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(every, lambda i: F.get("codes", i).isin(anchors))
    places = F.flatten(F.transform("hits", lambda i: F.transform(agreed(i, F.get("codes", i)), lambda t: place(t, i - t["a_at"]))))
    return occ.select("doc_id", "n_words", "codes", hits.alias("hits")).select("doc_id", "n_words", places.alias("places"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    out = found.withColumn("real", F.filter("places", lambda x: x["found"])).withColumn("own", F.filter("real", lambda x: x["base"]))
    starts = F.transform("own", lambda x: x["start"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("own").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(F.col("own")).alias("base_labels"), labels(F.col("real")).alias("labels"), F.round(score, 9).alias("score"))


_VALUES = ", ".join(f"('{label}', '{text}', '{key}', {base})" for label, text, key, base in TEMPLATES)
#: DuckDB SQL for the rows of the query
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
 t(label, text, key, base) AS (VALUES {_VALUES}),
 k AS (SELECT *, len(string_split(substr(text, 1, strpos(text, key) - 1), ' ')) - 1 AS key_at, len(string_split(key, ' ')) AS key_len FROM t),
 tw AS (SELECT label, base, key_at, key_len, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM k),
 w AS (SELECT * FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM tw)),
 df AS (SELECT word, count(DISTINCT rid) AS df FROM w GROUP BY word),
 idf AS (SELECT tw.*, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df USING (word)),
 r AS (SELECT *, idf / sum(idf) OVER (PARTITION BY label) AS weight, row_number() OVER (PARTITION BY label ORDER BY idf DESC, i) AS r FROM idf),
 s AS (SELECT x.rid, a.label, x.pos - a.i AS start FROM w x JOIN r a ON a.word = x.word AND a.r = 1 JOIN r b ON b.label = a.label AND b.r = 2
  JOIN w y ON y.rid = x.rid AND y.pos = x.pos - a.i + b.i AND y.word = b.word WHERE x.pos >= a.i),
 p AS (SELECT s.rid, s.label, s.start, any_value(base) AS base, sum(CASE WHEN w.rid IS NULL THEN 0 ELSE weight END) AS score, bool_and(w.rid IS NOT NULL) FILTER (i >= key_at AND i < key_at + key_len) AS has_key
  FROM s JOIN r ON r.label = s.label LEFT JOIN w ON w.rid = s.rid AND w.pos = s.start + r.i AND w.word = r.word GROUP BY s.rid, s.label, s.start),
 f AS (SELECT *, has_key AND score >= {SHARE} AS found FROM p),
 g AS (SELECT rid, count(*) FILTER (found AND base) AS n_base, min(start) FILTER (found AND base) AS first_word, max(start) FILTER (found AND base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels, max(score) AS score FROM f GROUP BY rid)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN g USING (rid)"""
