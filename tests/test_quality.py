from conftest import corpus_of
from corpuscope.operators import quality as Q
from corpuscope.sources.corpus import wide_to_corpus


def _msgs(spark, data):
    return [r.message for r in Q.validate(corpus_of(spark, data)).orderBy("check_no", "pos").collect()]


def test_too_few(spark):                                           # A5
    assert any("too few" in m for m in _msgs(spark, {"a": ["only one"]}))


def test_long_phrase(spark):                                       # A6
    assert any("longer than 500" in m for m in _msgs(spark, {"a": ["x" * 600, "normal", "also normal"]}))


def test_case_insensitive_duplicate_names(spark):                  # A7, T-4
    rows = Q.validate(corpus_of(spark, {"Greeting": ["hi"], "greeting": ["hello"]})).collect()
    err = [r for r in rows if r.level == "error"]
    assert len(err) == 1 and "Greeting, greeting" in err[0].message


def test_repeat_warning_and_finder(spark):                         # A8, A9
    assert any("1 duplicate phrase" in m for m in _msgs(spark, {"a": ["hello", "hi"], "b": ["hello", "bye"]}))
    d = Q.repeated_phrases(corpus_of(spark, {"a": ["hello", "hi"], "b": ["hello", "bye"]})).collect()
    assert len(d) == 1 and d[0]["count"] == 2
    assert Q.repeated_phrases(corpus_of(spark, {"a": ["hello"], "b": ["goodbye"]})).count() == 0


def test_nontext_counts(spark):                                    # B3
    m = _msgs(spark, {"x": ["https://x.y", "<b>t</b>", "1,234.5", ".", "https://x/<b>"]})
    assert any("has 5 non-text" in s for s in m)    # url 2 + html 2 + numeric 1


def test_repeats_t11(spark):                                       # B4
    c = corpus_of(spark, {"a": ["x", "x", "y"], "b": ["x"]})
    d = Q.repeated_phrases(c).collect()[0]
    assert d["count"] == 3 and d.appears_in == "a, a, b"
    assert Q.repeated_phrases(c, distinct_intents=True).collect()[0].appears_in == "a, b"
    kept = sorted((r.intent, r.phrase) for r in Q.remove_repeats(c).collect())
    assert kept == [("a", "x"), ("a", "y")]
    within = c.withColumn("raw", c.phrase)
    assert sorted((r.intent, r.phrase) for r in Q.remove_repeats_within(within).collect()) == \
        [("a", "x"), ("a", "y"), ("b", "x")]


def test_remove_keeps_first(spark):                                # A8 remover
    c = corpus_of(spark, {"a": ["hello", "hi"], "b": ["hello", "bye"]})
    kept = sorted((r.intent, r.phrase) for r in Q.remove_repeats(c).collect())
    assert kept == [("a", "hello"), ("a", "hi"), ("b", "bye")]


def test_wide_compaction(spark):                                   # B5
    c = corpus_of(spark, {"a": ["1", "2", "3"], "b": ["4"]})
    w = Q.compact_wide(c, ["a", "b"]).orderBy("rn").collect()
    assert [(r.a, r.b) for r in w] == [("1", "4"), ("2", None), ("3", None)]


def test_pf1_cells(spark):                                         # B1, A3, A4
    wide = spark.createDataFrame([(0, "  hi ", None), (1, "", None), (2, "  ", None), (3, "NaN", None),
                                  (4, "nan", None), (5, None, None)], "row_pos bigint, g string, e string")
    rows = wide_to_corpus(wide, ["g", "e"]).collect()
    assert [(r.intent, r.phrase) for r in rows] == [("g", "hi")]


def test_preview_and_counts(spark):
    c = corpus_of(spark, {f"i{k}": [f"p{k}{j}" for j in range(5)] for k in range(7)})
    p = Q.preview(c).collect()
    assert len(p) == 15 and all(r.total == 5 for r in p)
    lc = Q.load_counts(c).collect()[0]
    assert lc.total_phrases == 35 and lc.total_intents == 7 and not lc.is_large


def test_rank_within_spans_ranges(spark):                          # offsets across fixed ranges
    from corpuscope.operators.ordering import rank_within
    rows = [(0 if i % 3 else 1, i * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "g bigint, pos bigint")
    got = {(r.g, r.pos): r.rn for r in rank_within(df, "g", ["pos"], "rn", width=7).collect()}
    for g in (0, 1):
        ps = sorted(p for gg, p in rows if gg == g)
        assert [got[(g, p)] for p in ps] == list(range(1, len(ps) + 1))
