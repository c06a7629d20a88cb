"""Each operator against a brute-force version, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontaminate, fst, language, license, lines, neardup, packing, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "é", "A A A", "x" * 3000, "one two\none two\none two", "All rights reserved. CC BY 4.0", "<|endoftext|>'re  'll\n\n x"]


def rows(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 150))) for _ in range(12)]
    out = list(ODD)
    for _ in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        cut = rng.randint(0, len(w) // 2) if rng.random() < 0.3 else 0
        out.append("\n".join([" ".join(w[cut:]), rng.choice(base)] if rng.random() < 0.4 else [" ".join(w[cut:])]))
    out += out[:12]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def vocabulary():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts(spark, docs, none):
    ranks, pattern, t = vocabulary()
    got = {r[0]: tuple(r)[1:] for r in fst.count_tokens(docs, ranks, pattern).collect()}
    for i, text, *_ in rows():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024)
    assert fst.count_tokens(none, ranks, pattern).count() == 0


def test_transducer_fuzz():
    ranks, pattern, t = vocabulary()
    rng, c = random.Random(3), fst.counter(ranks, pattern)
    parts = [*"abrevl'stmd  \n\t!?.19é中", "<|endoftext|>", "'re", "'ll", "  ", " '", " ", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert c.counts(texts) == [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_transducer_long_and_small():
    ranks, pattern, t = vocabulary()
    odd = [" " * 1_000_000, "!" * 300_000, "a\n" * 200_000, "é😀" * 100_000, "x" * 100_000 + " <|endoftext|> y", "", "中" * 200_000, "word we'll " * 300_000, "1" * 5000 + "'ll"]
    c = fst.Counter(ranks, pattern)
    assert c.counts(odd) == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]
    c.words = fst.Words(2000)  # emptied again and again
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 60))) for _ in range(200)) for _ in range(20)]
    assert c.counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_counts_odd_ids(spark):
    ranks, pattern, _ = vocabulary()
    df = spark.createDataFrame([(2**60 + 1, "a b"), (None, "a"), (None, None)], "doc_id long, text string").withColumn("n_tokens", F.lit(7)).coalesce(1)
    assert sorted(map(str, map(tuple, fst.count_tokens(df, ranks, pattern).collect()))) == sorted(map(str, [(2**60 + 1, 3, 2, False), (None, 1, 1, False), (None, 0, 0, False)]))


def test_packing(spark, docs, none):
    t, names = vocabulary()[2], packing.vocabulary()
    got = packing.pack(docs, names, 64, with_ids=True).collect()
    plain = packing.pack(docs, names, 64)
    assert sorted(map(str, plain.collect())) == sorted(map(str, packing.pack(docs, names, 64, with_ids=True).drop("ids").collect()))
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in own)
        assert len(ids) > 64 or len(own) == 1
        assert all(r["length"] == 64 for r in own[1:])
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_bin) <= math.ceil(sum(r["length"] for r in got) / 64 * 1.05) + 1
    assert packing.pack(none, names).count() == 0


def test_packing_odd_rows(spark):
    t, names = vocabulary()[2], packing.vocabulary()
    texts = [" " * 1_000_000, "!" * 300_000, "a\n" * 200_000, None]
    df = spark.createDataFrame([(2**60 + 1, texts[0]), (None, texts[1]), (2**60 + 1, texts[2]), (None, None)], "doc_id long, text string").withColumn("ids", F.lit(1)).coalesce(1)
    got = packing.pack(df, names).collect()
    assert {r["doc_id"] for r in got} == {2**60 + 1, None}
    n = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts]
    assert sum(r["length"] for r in got if r["doc_id"]) == n[0] + n[2] and sum(r["length"] for r in got) == sum(n)


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.add(n) for n in (6, 7, 8, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_language(spark, none):
    rng = random.Random(1)
    parts = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zug", "über", "straße"], "cc": ["que", "ñandú", "rojo"]}
    data = [(i, " ".join(rng.choice(parts[k]) for _ in range(20)), k, "s", 0) for i, k in enumerate(rng.choices(list(parts), k=300))]
    data += [(900, None, "aa", "s", 0), (901, "123 !!", "aa", "s", 0), (902, "日本", None, "s", 0)]
    docs = spark.createDataFrame(data, DOCS)
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 == 1 and x[0] < 900]
    assert held and all(got[x[0]]["lang_pred"] == x[2] for x in held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] in parts
    both = language.Mixture(model).predict(" ".join(parts["aa"] * 30 + parts["bb"] * 30))
    assert set(both[2]) == {"aa", "bb"} and abs(both[1] - 0.5) < 0.15
    assert language.identify(docs, language.fit(none)).where("lang_pred <> 'und'").count() == 0


def reach(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, none, k):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in rows()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert neardup.near_duplicates(none, k).count() == 0


def test_odd_sketch_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(1, 1 << 62, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 60) :], rng.integers(1, 1 << 62, 30).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = (neardup.whole_sketch(s).view(np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= apart


def test_suffix(spark, none):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(3000)) for _ in range(3)]
    data = []
    for i in range(40):
        t, x = rng.choice(base), rng.randint(0, 2000)
        t = list("".join(rng.choice("xyz") for _ in range(rng.randint(0, 300))) + t[x : x + rng.randint(300, 1000)])
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "Q"
        data.append((i, "".join(t)))
    data += [(100, None), (101, ""), (102, "a" * 1500), (103, "ab" * 900), (104, "z" * 400), (104, "other"), (105, base[0]), (105, base[0]), (106, base[1][:399])]
    seen = {}
    for _, t in data:
        b = (t or "").encode()
        for j in range(len(b) - 399):
            seen[b[j : j + 400]] = seen.get(b[j : j + 400], 0) + 1
    want = []
    for i, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = suffix.remove_repeats(df).select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert suffix.remove_repeats(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        b = [x for x in a if rng.random() > 0.1] + [rng.choice("abx") for _ in range(rng.randint(0, 2))]
        assert lines.similar(a, b) == (distance(a, b) <= max(len(a), len(b)) * 20 // 100)


def test_line_dedup(spark, docs, none):
    places, words = {}, []
    for i, t, *_ in rows():
        for k, line in enumerate((t or "").split("\n")):
            if w := tuple(lines.normalised(line)):
                places.setdefault(w, []).append((i, k))
    words = list(places)
    links = [(a, b) for a in range(len(words)) for b in range(a) if lines.similar(list(words[a]), list(words[b]))]
    group = {}
    for x, g in reach(range(len(words)), links).items():
        group.setdefault(g, []).extend(places[words[x]])
    drop = {p for g in group.values() for p in g if p != min(g)}
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    for i, t, *_ in rows():
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop)
        assert got[i]["text"] == kept and got[i]["n_removed"] == sum(p[0] == i for p in drop)
    assert lines.dedup_lines(none).count() == 0


def test_line_dedup_meets_all_similar(spark):
    """Against the edit similarity of all pairs, without SimHash."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    found = []
    for k in range(150):
        a = [rng.choice(words if k % 10 else words[:3]) for _ in range(rng.randint(4, 60))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 5))):
            i = rng.randrange(len(b))
            b[i : i + rng.choice((1, 1, 0))] = rng.choice(([], [rng.choice(words)], [rng.choice(words)]))
        found += [a, b]
    at = found
    links = [(i, j) for i in range(len(at)) for j in range(i) if distance(at[i], at[j]) <= max(len(at[i]), len(at[j])) * 20 // 100]
    want = reach(range(len(at)), links)
    assert sum(i != x for i, x in want.items()) > 70
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(at)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df).collect()}
    lost = [i for i, x in want.items() if got[i] != int(i != x)]
    assert len(lost) <= 0.05 * sum(i != x for i, x in want.items()) and all(got[i] == 0 and len(at[i]) > 12 for i in lost)


def test_line_dedup_short_and_unspaced(spark):
    han, thai = "今天天气很好我们一起去公园散步吧", "วันนี้อากาศดีมากเราไปเดินเล่นในสวนกันเถอะ"
    texts = [f"Share this page\n\n{han}\n{thai}\n* * *\nyes", f"share this page!\n\n{han}\n{thai}\n* * *\nno", f"Share this site\n\n{han.replace('公', '花')}\n---\nYes", "全部不同的另一句话写在这里"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {0: texts[0], 1: "\nno", 2: "Share this site\n\n---", 3: texts[3]}


def test_license(spark, docs, none):
    got = license.scan(docs)
    own = F.filter("places", lambda x: x["found"] & x["base"])
    got = {r[0]: (r[1], sorted(map(tuple, r[2]))) for r in got.select("doc_id", "n_words", F.transform(own, lambda x: F.struct("doc_id", x["start"], x["label"]))).collect()}
    for i, t, *_ in rows():
        w = re.findall(license.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = sorted((i, k, label) for label, text, _, base in license.TEMPLATES if base for k in range(len(w)) if w[k : k + len(text.split())] == text.split())
        assert got[i] == (len(w), want)
    assert license.scan(none).count() == 0


def test_license_sql(spark, tmp_path):
    texts = [t for _, t, _, _ in license.TEMPLATES]
    rows = [(i, t and t.upper()) for i, t in enumerate([*texts, *(" ".join(t.split()[:-1]) for t in texts), None, "", "é" * 9])]
    rows += [(90, "general general public license cc by nc cc by, all rights reserved"), (90, "all rights x"), (91, ", ".join(texts * 3)), (92, "licensed under the x license version 2 0 under the apache license version 2 0")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet{'/*.parquet' if folder == str(tmp_path) else ''}')")
        got, want = license.op3_license_scan(spark, folder), con.sql(license.ORACLE)
        assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_decontamination(spark, none):
    plain = "the quick brown fox walks over a lazy sleeping dog beside the old stone bridge at night"
    items = spark.createDataFrame([(1, "If Mary buys 12 apples and then 12 pears at 3 usd each how many coins does Mary need in total today"), (2, plain), (3, None), (4, "short one"), (5, plain + " again")], "item_id long, text string")
    data = [
        (1, "Well. If Mary buys 12 apples and then 12 pears at 3 usd each how many coins does Mary need in total today. Bye"),
        (2, "Well. If Peter buys 7 apples and then 7 pears at 9 usd each how many coins does Peter need in total today."),
        (3, "Well. If Peter buys 7 apples and then 8 pears at 9 usd each how many coins does Anna need in total today."),
        (4, "IF MARY BUYS 12 APPLES AND THEN 12 PEARS AT 3 USD EACH HOW MANY COINS DOES MARY NEED IN TOTAL TODAY"),
        (5, "nothing here of the kind, the quick brown fox walks over a lazy"),
        (6, None), (7, ""), (8, "x " + plain.upper()), (8, "x " + plain.upper()),
    ]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in data], DOCS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (8, 2), (8, 5)}
    assert got[2, 1]["changed"] and not got[1, 1]["changed"]
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def test_decontamination_verbatim(spark):
    texts = ["What is the capital city of the largest country in Africa?", "Compute 12 + 15 + 18 + 21 and 4 * 7 * 9 then 3 + 5 + 8 in total", "Who wrote the novel War and Peace?"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    data = [(i, f"Question: {t} Answer: yes") for i, t in enumerate(texts)]
    data += [(10, "Compute 1 + 2 + 3 + 4 and 5 * 6 * 7 then 9 + 10 + 11 in full"), (11, "Who wrote the novel War and Dust?"), (12, "the capital city of the largest country")]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in data], DOCS)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, items).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:800] = x[0]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 7), (9005, [None] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
        assert all(abs(s[v] - z) < 1e-9 for _, v, z in found)
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.search(few, F.lit(True)).where("query_id = 0").collect()] == [(0, k + 1, v) for k, v in enumerate(sorted((1, 2), key=lambda v: -(x[v].astype(float) @ x[0])))]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_chat(spark):
    import json

    texts = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "a\nb", "", "<\\|", "😀"]
    records = [json.dumps({"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": t}]}) for t in texts]
    records += [json.dumps({"instruction": "do", "input": "this", "output": "done"}), json.dumps({"prompt": "p", "completion": "c"}), json.dumps({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}), json.dumps({"messages": []}), "no json", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.format_records(df, "record").collect()}
    for i, t in enumerate(texts):
        text, mask = got[i]["formatted"], got[i]["loss_mask"]
        assert chat.read(text) == [("user", t), ("assistant", t)]
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t]
        assert text.count("<|im_start|>") == 2
    n = len(texts)
    assert chat.read(got[n]["formatted"]) == [("user", "do\n\nthis"), ("assistant", "done")]
    assert chat.read(got[n + 1]["formatted"]) == [("user", "p"), ("assistant", "c")]
    assert chat.read(got[n + 2]["formatted"]) == [("user", "h"), ("assistant", "g")]
    assert [got[k]["formatted"] for k in range(n + 3, n + 7)] == [""] * 4
    assert chat.digest(chat.format_records(df, "record")).where("conv_id = 0").first()["n_turns"] == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(i, t, "en", "s", 0) for i, t, *_ in rows(7)]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    leak = next(t for _, t, *_ in data if t and len(t.split()) > 40)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["offset"] + r["length"] <= 1024 for r in out)
    left = {r["doc_id"] for r in out}
    assert not left & {i for i, t, *_ in data if not re.search(r"[^\W\d_]", t or "")}
    docs = spark.createDataFrame(data, DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in docs.collect()} == left


def test_blocks_compare_pairs_once(spark, monkeypatch):
    """Lines that share many large blocks are compared once, close ones first, and the groups are those of all pairs."""
    from graphloom.llm import common, lines

    rng, seen = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    tail = [word() for _ in range(60)]
    own = [[word() for _ in range(rng.randint(4, 24))] + tail for _ in range(70)]
    own += [x[:-3] + [word() for _ in range(3)] for x in own[:30]]
    across = common._across

    def counted(rows, how):
        out = across(rows, how)
        seen.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(common, "MANY", 20)
    monkeypatch.setattr(common, "FULL", 0)
    monkeypatch.setattr(common, "_across", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(own)], "id long, text string").selectExpr("id", "hash(text) th", "text")
    got = {r["id"]: r["first_id"] for r in lines.duplicate_lines(docs).collect()}
    want = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if lines.similar(own[i], own[j]) and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    assert got == {i: x for i, x in enumerate(want) if i != x}
    assert len(seen) == 2 and all(n == once for n, once in seen) and sum(n for n, _ in seen) > 0


def test_line_blocks_make_no_pairs(spark, monkeypatch):
    """Lines of a block that may be linked and aren't (the same words in other orders) make no rows for their pairs."""
    rng, counts = random.Random(5), {}
    head, tail = ([f"{c}word{i:03d}" for i in range(30)] for c in "ht")
    own = [rng.sample(head, 30) + tail for _ in range(60)]
    write = lines.materialize

    def counted(df, tag):
        out = write(df, tag)
        counts[tag] = max(counts.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(own)], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in lines.dedup_lines(docs).collect())
    assert max(counts.values()) <= lines.KEYS * len(own)


def test_components_label_vertices_once(spark, monkeypatch):
    """A long path takes several rounds, and its vertices aren't labelled anew in each; the components are those of a plain walk."""
    from graphloom.llm import common

    rng, made, n = random.Random(9), [], 600
    write = common.materialize

    def counted(df, tag):
        out = write(df, tag)
        if tag.endswith("-labels"):
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", counted)
    ids = rng.sample(range(10_000), n + 40)
    path, rest = ids[:n], ids[n:]
    edges = list(zip(path, path[1:])) + [(rest[0], x) for x in rest[1:20]] + [(rest[20], rest[21]), (rest[21], rest[22]), (rest[22], rest[20])] + [(x, x) for x in rest[23:]]
    rng.shuffle(edges)
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    want = {x: min(own) for own in (path, rest[:20], rest[20:23]) for x in own}
    assert got == want
    assert len(made) > 2 and sum(made) <= 3 * len(want)
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long"), "t").count() == 0
