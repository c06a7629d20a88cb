"""Defined cases of every operator: missing and shared ids, clashing columns, repeated rows, ties, very long and empty texts, empty tables."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontaminate, fst, language, license, lines, neardup, packing, registry, suffix

BIG = 2**60 + 1
LINE = "one plain line of words that everybody likes to copy into every page"


def table(spark, rows, extra=()):
    """``doc_id, text`` in one partition, with further columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for c in extra:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


CLASH = ["id", "th", "key", "line", "drop", "row", "lines", "kept", "n_lines", "n_removed", "h", "pos", "comp", "t0", "words", "codes", "uid", "ids", "first", "p", "s", "v", "n"]


def test_lines_odd_ids(spark):
    rows = [(None, LINE), (None, LINE + "\nmine"), (BIG, LINE + "\nown"), (BIG, "x " + LINE), (BIG, "x " + LINE), (BIG + 1, LINE.upper())]
    out = lines.dedup_lines(table(spark, rows, CLASH)).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in out) == sorted([("None", "", 1), ("None", "mine", 1), (str(BIG), LINE + "\nown", 0), (str(BIG), "", 1), (str(BIG), "", 1), (str(BIG + 1), "", 1)])
    assert all(r["id"] == "own id" and r["row"] == "own row" for r in out)
    docs = table(spark, rows, CLASH)
    assert lines.stage(spark, docs, "").columns == docs.columns


def test_lines_chains(spark):
    """A line linked to two others that aren't linked with each other joins them, whichever of them is met first."""
    rows = []
    for k in range(40):
        w = [f"w{k}word{i}" for i in range(20)]
        left, right = list(w), list(w)
        for i in (1, 4, 7, 9):
            left[i], right[i + 10] = f"left{k}x{i}", f"right{k}x{i}"
        rows += [(3 * k + j, " ".join(x)) for j, x in enumerate((left, w, right))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert got == {i: int(i % 3 > 0) for i in range(120)}


def test_lines_very_long(spark):
    long = "\n".join(f"line number {i} of a text that is long enough for all windows {i * 7}" for i in range(30_000))
    one = " ".join(f"w{i}" for i in range(300_000))
    out = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, [(1, long), (2, long + "\nand more here than before at the end"), (3, one), (4, one + " z")])).collect()}
    assert out[1]["n_removed"] < 30_000 and out[2]["text"].split("\n")[-1] == "and more here than before at the end"
    assert out[2]["n_removed"] == 30_000 and out[3]["n_removed"] == 0 and out[4]["n_removed"] == 1


def test_neardup_odd_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(None, a), (None, b), (BIG, a + " x"), (12, b), (12, "something else of its own"), (13, a), (13, a), (7, None), (None, "")]
    got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in neardup.near_duplicates(table(spark, rows, CLASH), 2).collect())
    assert got == sorted([("None", 59, "13"), ("None", 59, "12"), (str(BIG), 60, "13"), ("12", 59, "12"), ("12", 4, "12"), ("13", 59, "13"), ("13", 59, "13"), ("7", 0, "7"), ("None", 0, "None")])
    docs = table(spark, rows, CLASH)
    kept = neardup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("12", b), ("12", "something else of its own"), ("13", a), ("7", "None"), ("None", "")])


def test_neardup_recall(spark):
    """Pairs at and just above the threshold, each of its own words: found all but by brute force."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        n = int(rng.integers(20, 200))
        w = [f"a{k}x{i}" for i in range(n)]
        v = list(w)
        for i in rng.choice(n, int(rng.integers(1, max(2, n // 18))), replace=False):
            v[i] = f"b{k}x{i}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t in rows}
    want = {i for i in range(0, 300, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    got = {r["id"] - 1 for r in neardup.near_duplicates(table(spark, rows), 2).collect() if r["component_id"] != r["id"]}
    assert got == want and len(want) > 75


def test_suffix_odd_ids(spark):
    a = "".join(chr(97 + (i * i) % 23) for i in range(900))
    rows = [(None, a), (BIG, a), (BIG, a + "tail"), (None, None), (3, "short")]
    got = sorted((str(r["id"]), r["n_bytes"], r["n_removed"], len(r["kept"])) for r in suffix.remove_repeats(table(spark, rows, CLASH)).collect())
    assert got == sorted([("None", 900, 900, 0), (str(BIG), 900, 900, 0), (str(BIG), 904, 900, 4), ("None", 0, 0, 0), ("3", 5, 0, 5)])


def test_suffix_very_long(spark):
    rng = np.random.default_rng(0)
    base = "".join(map(chr, rng.integers(97, 123, 700_000)))
    rows = [(1, base), (2, base[300_000:301_000] + "!" + "".join(map(chr, rng.integers(97, 123, 500)))), (3, "".join(map(chr, rng.integers(97, 123, 300_000))) + base[262_000:262_500])]
    got = {r["id"]: (r["n_removed"], [list(x) for x in r["spans"]]) for r in suffix.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: (1500, [[262_000, 262_500], [300_000, 301_000]]), 2: (1000, [[0, 1000]]), 3: (500, [[300_000, 300_500]])}


def test_license_odd(spark):
    many = "cc by " * 100_000
    got = {(str(r["doc_id"]), r["n_words"]): r["places"] for r in license.scan(table(spark, [(None, "CC BY"), (BIG, many), (BIG, None), (BIG, "")], CLASH)).collect()}
    assert set(got) == {("None", 2), (str(BIG), 200_000), (str(BIG), 0)}
    assert sum(p["found"] for p in got[str(BIG), 200_000]) == 100_000 and [p["label"] for p in got["None", 2] if p["found"]] == ["cc-by"]


def test_decontaminate_odd(spark):
    item = "how many red apples does the old farmer sell on a sunny day in the small town"
    items = spark.createDataFrame([(5, item), (5, item), (None, None), (6, "")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, item), (BIG, filler + " " + item), (BIG, "clean"), (2, item), (2, item), (3, None), (4, "")]
    got = sorted((str(r["doc_id"]), r["item_id"], r["first_token"]) for r in decontaminate.leaks(table(spark, rows, CLASH), items).collect())
    assert sorted(got)[1:] == [("2", 5, 0), ("None", 5, 0)] and sorted(got)[0][:2] == (str(BIG), 5) and sorted(got)[0][2] >= 200_000


def test_language_odd(spark):
    a, b = "".join(chr(0x4E00 + i) for i in range(200)), "".join(chr(0xAC00 + i) for i in range(200))
    rng = np.random.default_rng(1)
    text = lambda s: " ".join("".join(s[i] for i in rng.integers(0, 200, 6)) for _ in range(30))
    data = [(i, text(a if i % 2 else b), "aa" if i % 2 else "bb") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for c in ("p", "row", "lang_pred", "score"):
        docs = docs.withColumn(c, F.lit("own"))
    model = language.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(got[i] == lang for i, _, lang in held) >= 0.9 * len(held)
    odd = table(spark, [(None, a), (BIG, "²½Ⅷ ١٢"), (BIG, None), (BIG, ""), (None, text(b) * 300)])
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in language.identify(odd, model).collect()) == sorted([("None", "aa"), (str(BIG), "und"), (str(BIG), "und"), (str(BIG), "und"), ("None", "bb")])
    tie = spark.createDataFrame([(k, "same words here", lang) for k in range(40) for lang in ("x", "y")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(tie, language.fit(tie)).collect()} == {"x"}
    kept = language.stage(spark, docs.union(docs.limit(1).withColumn("text", F.lit("123"))), "")
    assert kept.columns == docs.columns and kept.count() == 600


def test_nearest_odd(spark):
    x = np.random.default_rng(0).normal(size=(60, 4)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(7, x[7]), (8, x[9]), (None, x[0]), (100, [1.0, 2.0]), (101, [2.0, 1.0]), (102, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ask", F.lit("own")).withColumn("vec", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(0, 20, 100)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [v for _, v, _ in sorted(got[100])] == [101, 102] and len(got[0]) == 20 and len(got[20]) == 20
    v = np.array([r[1] for r in rows[:62]], np.float32).astype(float)
    ids = np.array([r[0] for r in rows[:62]])
    for q in (0, 20):
        s = v @ v[q]
        want = sorted({(-round(float(s[i]), 9), int(ids[i])) for i in range(62) if ids[i] != q})[:20]
        assert [(-round(z, 9), i) for _, i, z in sorted(got[q])] == want


def test_chat_odd(spark):
    bad = ['{"messages": ["a"]}', '{"messages": [null]}', '{"messages[].role": "user", "messages[].content": "x"}', '{"messages": [["a"]]}', '{"messages": [{"role": "user", "content": "a"}, "b"]}', '{"messages": {"role": "user", "content": "x"}}', "[" * 100_000, "{}", '{"a": 1}']
    good = ['{"messages": [{"role": "gpt", "content": "a", "name": "n"}, {"role": "", "content": null}], "id": 7}', '{"instruction": "do", "output": "done", "category": "x"}']
    df = spark.createDataFrame([(BIG, x) for x in bad] + [(None, x) for x in good], "conv_id long, record string").coalesce(1).withColumn("layout", F.lit("own")).withColumn("other", F.lit(5))
    out = chat.format_records(df, "record").collect()
    assert [chat.read(r["formatted"]) for r in out] == [[]] * len(bad) + [[("gpt", "a"), ("", "")], [("user", "do"), ("assistant", "done")]]
    assert all(r["other"] == 5 for r in out) and [r["conv_id"] for r in out] == [BIG] * len(bad) + [None] * 2
    assert chat.format_records(df.limit(0), "record").count() == 0


def test_chat_query(spark, tmp_path):
    """The query itself against plain Python, roles of any name and texts of any kind."""
    texts = ["", None, "<|im_end|>", "\\<|", "a\nb\n", "😀" * 300_000, "x", "x"]
    rows = [(c, k, role, texts[(c + k) % len(texts)]) for c in range(8) for k, role in enumerate(["system", "user", "gpt", "assistant", "bot"])]
    rows += [(5, 9, "assistant", "same"), (5, 9, "assistant", "same")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op7_chat_format(spark, str(tmp_path)).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        turns = [(r, t or "") for _, k, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert len(got) == 9


def test_token_ties(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "x" * 1_200_000)]
    got = sorted(map(tuple, fst.count_tokens(table(spark, rows, CLASH), *packing.vocabulary()[:2]).select("doc_id", "n_tokens", "over_limit").collect()))
    assert got[:3] == [(1, 2, False), (1, 2, False), (2, 2, False)] and got[3][2]


def test_packing_repeated(spark):
    out = packing.pack(table(spark, [(1, "a b"), (1, "a b"), (None, "a b")], CLASH), packing.vocabulary()).collect()
    assert len(out) == 3 and len({r["sequence_id"] for r in out}) == 1 and sorted(r["offset"] for r in out) == [0, 3, 6]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
    for t, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    n = registry.QUERIES[name](spark, str(tmp_path)).count()
    assert n == (1 if name == "op7_chat_format" else 0)


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chat_records_are_json():
    assert chat.canonical(json.loads('{"messages": []}'), chat.registry()[0][chat.fingerprint({"messages[]"})]) == []
