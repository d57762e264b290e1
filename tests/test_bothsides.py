"""Columns of both sides of many pairs, and queries that must not shuffle texts."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuscope.operators import cells as C
from corpuscope.operators import encode as E
from corpuscope.operators import recommend as R
from corpuscope.operators import similarity as S
from corpuscope.operators.bothsides import join_both_sides
from corpuscope.sinks import files as SK
from corpuscope.sources import csv_split
from tests.conftest import emb_corpus


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_both_sides_equals_joins(spark):
    values = spark.range(300).selectExpr("id % 250 AS k", "concat('text ', id) AS t", "IF(id % 7 = 0, NULL, array(id, id)) AS a")
    pairs = spark.range(3000).selectExpr("IF(id % 11 = 0, NULL, (id * id) % 260) AS x", "(id * 31) % 260 AS y", "id AS n")
    names = {"t": ("t_x", "t_y"), "a": ("a_x", "a_y")}
    want = (pairs.join(values.toDF("x", "t_x", "a_x"), "x").join(values.toDF("y", "t_y", "a_y"), "y")
            .select("x", "y", "n", "t_x", "a_x", "t_y", "a_y"))
    expected = Counter(str(tuple(r)) for r in want.collect())
    for limit, block in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 500)):
        got = join_both_sides(pairs, ("x", "y"), values, "k", names, F.octet_length("t"), block_bytes=block, broadcast_bytes=limit)
        plan = got._jdf.queryExecution().toString()
        assert ("MapInArrow" in plan) == (limit == 0)
        assert got.columns == want.columns
        assert Counter(str(tuple(r)) for r in got.collect()) == expected


def test_placed_conflicts_carry_no_text_and_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"l{i % 3}", f"phrase {i % 20}", rng.normal(size=6)) for i in range(60)]
    corpus = emb_corpus(spark, rows)
    phrases = S.phrase_index(corpus)
    placed = S.place_pairs(S.conflict_pairs(corpus, 0.3).localCheckpoint(), phrases)
    assert not {"phrase", "similar_to"} & set(placed.columns)
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    whole = S.phrase_conflicts(corpus, 0.3, phrases=phrases)
    assert _rows(S.with_texts(placed, phrases).select(*whole.columns)) == _rows(whole)
    assert _rows(S.with_texts(placed, phrases, few=True).select(*whole.columns)) == _rows(whole)
    plain = S.phrase_conflicts(corpus, 0.3, method="plain")
    key = ["phrase_id", "other_id", "phrase", "similar_to", "is_exact", "intent", "other_intent"]
    assert _rows(whole.select(*key)) == _rows(plain.select(*key))
    # actions need no texts in the conflicts, and the chosen ones are those of all
    every = R.phrase_actions(placed, corpus)
    assert _rows(R.filter_actions(every)) == _rows(R.filter_actions(R.phrase_actions(placed, corpus, kinds=R.STRONG)))
    top = R.cap_actions(every, 5).collect()
    assert R.cap_actions(R.phrase_actions(placed, corpus, first=5), 5).collect() == top


def test_small_blocks_are_dealt_together(spark):
    rng = np.random.default_rng(5)
    corpus = emb_corpus(spark, [(i, f"l{i % 4}", f"p{i}", rng.normal(size=4)) for i in range(200)])
    found = S._conflicts_blocked(corpus, 0.5, "embedding", 2)
    plan = found._jdf.queryExecution().toString()
    assert " 99)" not in plan    # 100 blocks of two rows would copy every row 100 times
    assert _rows(found.select("phrase_id", "other_id")) == _rows(S._conflicts_plain(corpus, 0.5, "embedding").select("phrase_id", "other_id"))


def test_exact_products_take_little_memory():
    import tracemalloc

    n, dim = 512, 256
    v = np.random.default_rng(0).normal(size=(n, dim))
    batch = pa.RecordBatch.from_pydict({**{c: np.arange(n) for c in C.Block.COLUMNS}, "v": list(v)})
    block = C.Block([batch], dim)
    i, j = np.divmod(np.arange(n * n // 2), n)
    tracemalloc.start()
    got = block.exact(i, block, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(got, (u @ u.T)[i, j])
    assert peak < 64 << 20


def test_first_token_without_sorting_all(spark):
    tokens = spark.range(40).selectExpr("id % 4 AS phrase_id", "CAST(id DIV 4 AS INT) AS token_pos", "1 AS mask", "array(CAST(id AS DOUBLE), 1.0D) AS vec")
    known = E.pool(tokens, "cls", first_pos=0)
    assert "as int) = 0" in known._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[1].split("\n", 1)[0]
    assert _rows(known.selectExpr("phrase_id", "CAST(embedding AS STRING)")) == _rows(E.pool(tokens, "cls").selectExpr("phrase_id", "CAST(embedding AS STRING)"))


def test_csv_files_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "FILE_ROWS", 10)
    path = SK.write_csv(spark.range(95).coalesce(1).selectExpr("id", "concat('a\\n', id) AS t"), str(tmp_path / "c"), ["id"])
    assert spark.read.text(path).select("_metadata.file_path").distinct().count() >= 10
    assert spark.read.option("header", True).option("multiLine", True).csv(path).count() == 95
    line = b"x" * 100_000
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 50, "block": [0] * 50, "id": list(range(50)), "line": [line] * 50,
                                        "state": [0] * 50, "base": [0] * 50})
    out = list(csv_split._records("utf-8")(iter([batch])))
    assert sum(b.num_rows for b in out) == 50 and max(b.nbytes for b in out) < 2 << 20


def test_only_texts_with_a_vector_are_shuffled(spark, tmp_path):
    from corpuscope.sources import tables as T

    spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "text again"), (None, "none")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in (1, 3, 3, 7, 60)] + [(None, [1.0, 0.0], 1)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = T.embedded_corpus(spark, str(tmp_path))
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    few, T.BROADCAST_IDS = T.BROADCAST_IDS, 0
    try:
        plain = T.embedded_corpus(spark, str(tmp_path))
        assert "LeftSemi" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert Counter(map(str, found.collect())) == Counter(map(str, plain.collect()))
    finally:
        T.BROADCAST_IDS = few
    assert found.count() == 1 + 2 * 2 + 1


def test_stored_pairs_give_the_same_similarity(spark):
    sims = sorted({round(x, 6) for x in np.random.default_rng(1).uniform(-1, 1, 20000).tolist()} | {-1.0, 0.0, 0.3, 1.0})
    pairs = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate(sims)], S.PAIR_SCHEMA)
    packed = S.packed_pairs(pairs)
    assert dict(packed.dtypes)["millionths"] == "int"
    assert sorted(r["sim"] for r in S.unpacked_pairs(packed).collect()) == sims


def test_dealt_conflicts_are_two_places_and_a_similarity(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 55, f"l{i % 3}", f"phrase {i % 20}", rng.normal(size=6)) for i in range(60)]  # ids repeat
    corpus = emb_corpus(spark, rows)
    phrases = S.phrase_index(corpus)
    placed = S.place_pairs(S.conflict_pairs(corpus, 0.3), phrases)
    small = _rows(S.with_texts(placed, phrases))
    carried = []

    def deal(*args, carry=None, **more):
        carried.append(carry)
        return join_both_sides(*args, carry=carry, broadcast_bytes=0, **more)

    monkeypatch.setattr(S, "join_both_sides", deal)
    assert _rows(S.with_texts(placed, phrases)) == small
    assert carried == [["place", "other_place", "sim"]]
    phrases.few = False
    assert _rows(S.with_texts(placed, phrases)) == small


def test_changes_and_distinct_texts_go_by_digest(spark):
    from corpuscope.operators.incremental import corpus_changes

    corpus = emb_corpus(spark, [(i, f"l{i % 2}", f"phrase {i % 4}", np.ones(3)) for i in range(8)])
    edited = corpus.withColumn("phrase", F.when(F.col("phrase_id") == 3, "new").otherwise(F.col("phrase")))
    changes = corpus_changes(corpus, edited)
    assert {r["phrase_id"]: r["change"] for r in changes.collect()} == {i: "edited" if i == 3 else "same" for i in range(8)}
    pairs = spark.createDataFrame([], "sim3 double")
    assert R.exec_summary(edited, pairs).first()["unique_phrases"] == 5
    for df in (changes, R.exec_summary(edited, pairs)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2" in text


def test_report_deals_numbers_alone_and_keeps_its_order(spark, tmp_path):
    rng = np.random.default_rng(7)
    corpus = emb_corpus(spark, [(i, f"l{i % 3}", f"phrase {i % 20}", rng.normal(size=4)) for i in [*range(60), 5, 6]])
    phrases = S.phrase_index(corpus)
    placed = S.place_pairs(S.conflict_pairs(corpus, 0.5), phrases)
    for few in (True, False):
        phrases.few = few
        dealt = S.dealt_by_similarity(placed, phrases)
        assert _rows(dealt) == _rows(placed)
    phrases.few = True
    cols = ["phrase_id", "intent", "other_id", "other_intent", "sim", "is_exact"]
    out = S.dealt_by_similarity(placed, phrases).select(*cols)
    line = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1].split("\n") if "Project" in x)
    assert "place" in line and "intent" not in line and "phrase_id" not in line
    path = SK.write_named_csv(out, str(tmp_path), "full_confusion_report", dealt=True, compression="gzip")
    files = sorted(tmp_path.glob("full_confusion_report/part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    back = spark.read.option("header", True).schema(out.schema).csv(path)
    assert _rows(back) == _rows(out)
    sims = [r["sim"] for f in files for r in spark.read.option("header", True).schema(out.schema).csv(str(f)).collect()]
    assert sims == sorted(sims, reverse=True) and len(sims) > 100


def test_project_parts_are_stored_small(spark, tmp_path):
    SK.save_project(str(tmp_path), "p", {"pairs": spark.range(10)}, {"saved_at": "1"})
    assert list(tmp_path.glob("project=p/data/*/pairs/part-*.zstd.parquet"))


def test_pairs_of_a_right_value_leave_a_task_together(spark):
    """A columnar file of the result then holds a repeated text once, not once per pair."""
    values = spark.range(400).selectExpr("id AS k", "concat('text ', id) AS t")
    pairs = spark.range(40_000).selectExpr("id % 400 AS x", "(id * 7 + id DIV 400) % 400 AS y", "id AS n").repartition(16)
    got = join_both_sides(pairs, ("x", "y"), values, "k", {"t": ("tx", "ty")}, F.octet_length("t"), broadcast_bytes=0)
    runs, held = 0, 0
    for part in got.rdd.glom().map(lambda rows: [r["y"] for r in rows]).collect():
        runs += sum(a != b for a, b in zip([None, *part], part))
        held += len(set(part))
    assert got.count() == 40_000
    # one run for each left block and right value of a task; in the order they came there are ten times as many
    assert runs <= 4 * held < 8_000
