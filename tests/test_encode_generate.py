import pytest
from pyspark.sql import functions as F

from conftest import corpus_of
from corpuscope.operators import encode as E
from corpuscope.operators import generate as G


def test_mean_pool_with_mask(spark):                               # B19, EMB-2
    t = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (0, 1, 1, [0.0, 1.0]), (0, 2, 0, [5.0, 5.0]),
                               (1, 0, 0, [3.0, 3.0])], "phrase_id bigint, token_pos int, mask int, vec array<double>")
    out = {r.phrase_id: r.embedding for r in E.pool(t, "mean", normalize=False).collect()}
    assert out[0] == [0.5, 0.5] and out[1] == [0.0, 0.0]
    cls = {r.phrase_id: r.embedding for r in E.pool(t, "cls", normalize=False).collect()}
    assert cls[0] == [1.0, 0.0]


def test_unknown_pooling_raises(spark):                            # EMB-5
    t = spark.createDataFrame([], "phrase_id bigint, token_pos int, mask int, vec array<double>")
    with pytest.raises(ValueError):
        E.pool(t, "max")


def test_empty_and_zero_vectors(spark):                            # EMB-4, EMB-6
    df = spark.createDataFrame([(0, "")], "phrase_id bigint, phrase string")
    v = E.encode(df).first().embedding
    assert len(v) == 256 and all(x == 0.0 for x in v)
    empty = spark.createDataFrame([], "phrase_id bigint, phrase string")
    assert E.encode(empty).count() == 0 and "embedding" in E.encode(empty).columns


def test_hashing_is_unit_and_deterministic(spark):
    df = spark.createDataFrame([(0, "book a flight"), (1, "book a flight")], "phrase_id bigint, phrase string")
    a, b = [r.embedding for r in E.encode(df).orderBy("phrase_id").collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-12


def test_pluggable_encoder(spark):                                 # EMB-1
    def factory():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([(0, "abc")], "phrase_id bigint, phrase string")
    v = E.encode(df, encoder=factory).first().embedding
    assert abs(v[0] - 3 / (10 ** 0.5)) < 1e-12


def test_paraphrase_jobs(spark):                                   # B20, GEN-1 … GEN-3
    c = corpus_of(spark, {"a": [f"phrase {i}" for i in range(25)]})
    j = G.paraphrase_jobs(c, "humarin/chatgpt_paraphraser_on_T5_base", 2, 20)
    rows = j.collect()
    assert len(rows) == 40 and all(r.was_limited for r in rows)
    assert rows[0].generated.startswith("phrase") and not rows[0].generated.startswith("paraphrased")
    t5 = G.paraphrase_jobs(c, "Vamsi/T5_Paraphrase_Paws", 1, 20).first()
    assert t5.prompt.endswith(" </s>")                              # GEN-2
    grown = G.append_generated(c, j)
    assert grown.where(F.col("is_generated")).agg(F.min("row_pos")).first()[0] == 25   # SET-1


def test_pandas_generator(spark):
    c = corpus_of(spark, {"a": ["x"]})
    j = G.paraphrase_jobs(c, "m", 1, 20, generator=lambda: (lambda ps: ["paraphrased:  Y " for _ in ps]))
    assert j.first().generated == "Y"


def test_mean_pool_by_plain_sums(spark):                           # EMB-2
    """Where the numbers of a vector are known, one pass of sums gives the means of the vector aggregate."""
    rows = [(i % 7, i // 7, (0, 1, 2)[i % 3] if i % 7 else 0, [float(i % 5) - 2, 0.5 * i, 1.0]) for i in range(70)]
    rows += [(8, 0, None, [1.0, 2.0, 3.0]), (8, 1, 1, [3.0, 4.0, 5.0])]
    t = spark.createDataFrame(rows, "phrase_id long, token_pos int, mask int, vec array<double>")
    for unit in (True, False):
        got, want = E.pool(t, "mean", unit, dim=3), E.pool(t, "mean", unit)
        read = lambda df: {r.phrase_id: [round(x, 9) for x in r.embedding] for r in df.collect()}
        assert read(got) == read(want) and read(got)[0] == [0.0, 0.0, 0.0] and len(read(got)) == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Join" not in plan
