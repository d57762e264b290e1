import numpy as np

from conftest import corpus_of
from corpuscope.operators import textstore as T
from corpuscope.operators.encode import HashingEncoder, encode


def _corpus(spark):
    return corpus_of(spark, {"a": ["book a flight", "book a flight", "cancel order"], "b": ["book a flight", "", "hotel room"]})


def test_each_text_once_and_none_the_second_time(spark, tmp_path):  # KW-7
    from corpuscope.operators.keywords import phrase_keywords

    store, stats = T.TextStore(str(tmp_path), "kw", "array<string>"), {}
    c = _corpus(spark)
    want = {r.phrase_id: r.keywords for r in phrase_keywords(c).collect()}
    for computed in (4, 0):
        got = T.keywords_once(c, store, stats=stats)
        assert {r.phrase_id: r.keywords for r in got.collect()} == want and stats == {"computed": computed}
    more = c.union(corpus_of(spark, {"z": ["new text here", "hotel room"]}).selectExpr("phrase_id + 100", "intent", "intent_pos", "row_pos", "phrase"))
    assert T.keywords_once(more, store, stats=stats).count() == 8 and stats == {"computed": 1}


def test_a_batch_without_its_marker_does_not_count(spark, tmp_path):
    import os

    store, stats = T.TextStore(str(tmp_path), "kw", "array<string>"), {}
    T.keywords_once(_corpus(spark), store, stats=stats)
    batch = next(d for d in os.listdir(store.path) if d.startswith("batch="))
    os.rename(os.path.join(store.path, batch, "_SUCCESS"), str(tmp_path / "marker"))  # a run stopped before its commit
    assert store.read(spark).count() == 0
    T.keywords_once(_corpus(spark), store, stats=stats)
    assert stats == {"computed": 4} and store.read(spark).count() == 4


def test_model_sees_each_text_once_in_batches(spark, tmp_path):     # EMB-1
    log = str(tmp_path / "calls")

    def factory():
        def model(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 1.0] for t in texts])
        return model

    store, stats = T.TextStore(str(tmp_path), "vec", "array<double>"), {}
    texts = {"a": [f"text {'x' * i}" for i in range(50)] + ["text "] * 5}
    out = T.encode_once(corpus_of(spark, texts), store, factory, normalize=False, batch_size=8, stats=stats)
    assert {len(r.phrase): r.embedding for r in out.collect()} == {len(t): [len(t), 1.0] for t in texts["a"]}
    sizes = [int(x) for x in open(log)]
    assert max(sizes) <= 8 and sum(sizes) == 50 == stats["computed"]


def test_normalize_is_honoured(spark):                              # EMB-1
    c = corpus_of(spark, {"a": ["one two two three"]})
    raw, unit = (encode(c, encoder=HashingEncoder(16), normalize=n).first().embedding for n in (False, True))
    assert np.allclose(np.array(raw) / np.linalg.norm(raw), unit) and abs(np.linalg.norm(unit) - 1) < 1e-9
    assert all(x == int(x) for x in raw) and np.linalg.norm(raw) > 1


def test_null_text_and_clashing_column(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "phrase_id long, phrase string, _Digest string")
    out = T.keywords_once(df, T.TextStore(str(tmp_path), "kw", "array<string>")).collect()
    assert sorted((r.phrase_id, r._Digest, r.keywords) for r in out) == [(1, "x", []), (2, "y", [])]
