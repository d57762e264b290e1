"""What the shared analysis stores and shuffles: nothing that grows with the square of the corpus, and texts once."""

import os

import numpy as np
from pyspark.sql import functions as F

from corpuscope.operators import similarity as S
from corpuscope.operators.bothsides import join_both_sides
from corpuscope.plans import params as P
from corpuscope.plans.q_recommend import analysis
from corpuscope.session import checkpoint_dir
from corpuscope.sources.tables import embedded_corpus


def _tables(spark, root, n=80):
    rng = np.random.default_rng(11)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(n)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    texts = [(i, f"text number {i % 50}" if i % 9 else None) for i in range(2 * n)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    return str(root)


def _stored(spark):
    folder = f"{checkpoint_dir(spark)}/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_analysis_stores_neither_conflicts_nor_texts_twice(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    before = _stored(spark)
    corpus, _, conflicts = analysis(spark, sf)
    new = {name.rsplit("-", 1)[0] for name in _stored(spark) - before}
    assert not any(name.startswith("conflict_pairs") or name == "conflict-texts" for name in new), new
    key = ["phrase_id", "other_id", "sim", "is_exact", "intent", "other_intent"]
    want = S.phrase_conflicts(corpus, P.CONFLICT_T, method="plain").select(*key)
    assert want.count() and sorted(map(tuple, conflicts.select(*key).collect())) == sorted(map(tuple, want.collect()))


def test_texts_are_not_shuffled_to_their_vectors(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = embedded_corpus(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_texts_of_an_index_are_those_of_the_corpus(spark, tmp_path):
    corpus = embedded_corpus(spark, _tables(spark, tmp_path))
    phrases = S.phrase_index(corpus)
    shown = phrases.rows.join(phrases.texts, "text_id").select("phrase_id", "phrase")
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, corpus.select("phrase_id", "phrase").collect()))
    assert phrases.texts.count() == corpus.select("phrase").distinct().count()


def test_pairs_are_dealt_in_few_bytes(spark):
    """Rows that are dealt hold many pairs each; in buckets the result is the same."""
    n = 20_000
    values = spark.range(200).select(F.col("id").alias("k"), F.format_string("text %d", "id").alias("t"))
    pairs = spark.range(n).selectExpr("id % 200 AS x", "(id * 7) % 200 AS y", "id AS n")
    got = join_both_sides(pairs, ("x", "y"), values, "k", {"t": ("tx", "ty")}, F.octet_length("t"), block_bytes=600,
                          broadcast_bytes=0, bucket_bytes=100)
    want = pairs.selectExpr("x", "y", "n", "concat('text ', x) AS tx", "concat('text ', y) AS ty")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    dealt = got._jdf.queryExecution().toString()
    assert "packed" in dealt


def test_blocks_deal_vectors_in_their_own_precision(spark, tmp_path, monkeypatch):
    corpus = embedded_corpus(spark, _tables(spark, tmp_path))
    dealt, pairs = [], S._block_pairs
    monkeypatch.setattr(S, "_block_pairs", lambda u, n: dealt.append(u.schema.simpleString()) or pairs(u, n))
    found = S._conflicts_blocked(corpus, 0.3, "embedding", 20)
    assert "array<float>" in dealt[0] and "array<double>" not in dealt[0]
    want = S._conflicts_plain(corpus, 0.3, "embedding")
    key = lambda df: sorted((r["phrase_id"], r["other_id"], round(r["sim"], 9)) for r in df.collect())
    assert key(found) == key(want)
