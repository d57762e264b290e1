import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpuscope.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, kept string, S int, quality_stats int"


def brute(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    marked = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(marked), failed)


def base(r):
    return (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_statistics(spark):
    rnd = random.Random(8)
    bits = ["a", "b", "c d", "É|x", "日本#", "\n", " \n", "\x0b", "\x85", "\xa0", "word", "😀", "\r\n", "the end"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 150))), "x", 1, 2) for i in range(200)]
    rows += [(900, None, None, None, None), (901, "", "", 0, 0), (None, "x y z " * 40, "", 0, 0), rows[4], (902, "q" * 400_000, "", 0, 0),
             (903, "u v w " * 30_000, "", 0, 0)]
    rules = qr.DecisionList(((qr.Condition("symbol_share", True, 0.05),),))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = qr.quality_verdicts(df, rules).collect()
    assert sorted(map(base, got), key=str) == sorted((brute(*r[:2]) for r in rows), key=str)
    for r in got:
        assert r.kept == (not r.base_failed and r.n_symbols / max(1, r.word_chars) <= 0.05)
    out = qr.drop_rejected(df, rules)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_learns_conjunctions_and_keeps_the_rest():
    rnd = np.random.default_rng(9)
    x = {"a": rnd.random(6000), "b": rnd.random(6000), "c": rnd.random(6000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.3)) | (x["c"] > 0.95)
    held = {k: v[4000:] for k, v in x.items()}
    rules = qr.learn({k: v[:4000] for k, v in x.items()}, bad[:4000])
    said = np.zeros(2000, bool)
    for rule in rules.rules:
        said |= qr._covered(rule, held, 2000)
    assert (said == bad[4000:]).mean() > 0.97 and len(rules.rules) >= 2
    assert (said & ~bad[4000:]).sum() <= 0.03 * said.sum()


def test_held_out_labels(spark):
    """Learned on one table, held against the labels of another."""
    read = lambda sf, t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    rules = qr.learn_from(read("sf0.1", "documents"), read("sf0.1", "labels"))
    got = qr.quality_verdicts(read("sf0.01", "documents"), rules).join(read("sf0.01", "labels"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in got.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good >= 0.99 * (good + counts.get((1, False), 0)) and bad >= 0.9 * (bad + counts.get((0, True), 0))


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = qr.quality_verdicts(spark.read.parquet(path), qr.DecisionList()).collect()
    assert sorted(map(base, got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert all(r.kept != r.base_failed for r in got)


def test_empty_tables_and_odd_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert qr.learn_from(empty, labels) == qr.DecisionList()
    docs = spark.createDataFrame([(1, "a", "", 0, 0), (1, "b", "", 0, 0)], SCHEMA)
    assert qr.learn_from(docs, labels) == qr.DecisionList()
    assert qr.quality_verdicts(empty, qr.DecisionList()).collect() == []
    assert docs.select(F.lit(1)).count() == 2
