from pyspark.sql import functions as F

from conftest import emb_corpus
from corpuscope.functions.bands import Bands
from corpuscope.operators import search as S


def _queries(spark, rows):
    return spark.createDataFrame([(i, q, [float(x) for x in v]) for i, q, v in rows],
                                 "query_id bigint, query string, embedding array<double>")


def _unit(a):
    import math
    n = math.sqrt(sum(x * x for x in a))
    return [x / n for x in a]


def test_ties_ordered_by_phrase_and_first_seen_label(spark):       # B10, LIM-1, T-8
    rows = [(i, "a" if i % 2 == 0 else "b", f"p{i}", [1, 0]) for i in range(6)]
    c = emb_corpus(spark, rows)
    q = _queries(spark, [(0, "q", [1, 0])])
    for method in ("broadcast", "blocked"):
        h = S.search_hits(c, q, 0.5, 4, method=method).orderBy("rank").collect()
        assert [r.phrase_id for r in h] == [0, 2, 4, 1]    # label 'a' phrases come first (order a, b)
    dec = S.single_decision(S.search_hits(c, q, 0.5, 10)).collect()[0]
    assert dec.dominant_intent == "a"                    # 3 vs 3: first seen wins


def test_exact_removed_after_topk(spark):                          # B11, PF-6, T-18
    c = emb_corpus(spark, [(0, "a", "Book a Flight ", [1, 0]), (1, "b", "other", [0.9, 0.1])])
    q = _queries(spark, [(0, "book a flight", [1, 0])])
    assert S.drop_exact(S.search_hits(c, q, 0.5, 1)).count() == 0


def test_no_match_gives_new_intent_row(spark):                     # B12, SIM-12, T-19
    c = emb_corpus(spark, [(0, "a", "x", [1, 0])])
    q = _queries(spark, [(0, "q", [0, 1])])
    r = S.batch_audit(S.search_hits(c, q, 0.7, 20), q).collect()[0]
    assert r.recommended_intent is None and r.top_similarity == 0.0 and r.action == "NEW_INTENT"
    assert r.action_text == "NEW INTENT suggested"


def test_batch_action_bands(spark):                                # B13, PF-13
    sims = [0.99, 0.98, 0.86, 0.85, 0.71, 0.70]
    df = spark.createDataFrame([(s,) for s in sims], "s double")
    from corpuscope.functions.bands import batch_action
    got = [r.a for r in df.select(batch_action("s").alias("a")).collect()]
    assert got == ["DUPLICATE", "ADD", "ADD", "REVIEW", "REVIEW", "NEW_INTENT"]


def test_single_action_needs_confidence(spark):                    # B14, PF-14
    from corpuscope.functions.bands import single_action
    df = spark.createDataFrame([(0.90, 0.7), (0.90, 0.8)], "s double, c double")
    assert [r.a for r in df.select(single_action("s", "c").alias("a")).collect()] == ["REVIEW", "ADD"]


def test_totals_always_four(spark):                                # AGG-18
    c = emb_corpus(spark, [(0, "a", "x", [1, 0])])
    q = _queries(spark, [(0, "q", [1, 0]), (1, "r", [0, 1])])
    t = {r.action: r["count"] for r in S.action_totals(S.batch_audit(S.search_hits(c, q, 0.7, 5), q)).collect()}
    assert t == {"DUPLICATE": 1, "ADD": 0, "REVIEW": 0, "NEW_INTENT": 1}


def test_nested_matches_and_stats(spark):                          # SIM-13, AGG-14, AGG-15, AGG-20
    c = emb_corpus(spark, [(0, "a", "x", [1, 0]), (1, "b", "y", _unit([1, 0.3])), (2, "b", "z", _unit([1, 0.6]))])
    q = _queries(spark, [(0, "q", [1, 0])])
    h = S.search_hits(c, q, 0.5, 10)
    m = S.nest_matches(h).first().matches
    assert [x.idx for x in m] == [0, 1, 2]
    st = S.search_stats(h, Bands()).first()
    assert st.unique_intents == 2
    dist = {r.intent: r for r in S.intent_distribution(h).collect()}
    assert dist["b"]["count"] == 2 and abs(dist["b"].pct_results - 66.666667) < 1e-6
    bins = S.sim_histogram(h).collect()
    assert sum(r["count"] for r in bins) == 3 and max(r.bin for r in bins) <= 20


def test_display_results(spark):                                   # PF-7
    c = emb_corpus(spark, [(0, "a", "book flight", [1, 0])])
    q = _queries(spark, [(0, "book flight", [1, 0])])
    r = S.display_results(S.result_table(S.search_hits(c, q, 0.5, 5))).first()
    assert r.similarity_score == "1.0000" and r.match_type == "Exact" and r.keywords == "book, flight"


def test_search_is_cosine_and_tiles_agree(spark, monkeypatch):
    rows = [(i, f"l{i % 3}", f"p{i}", [1.0 + i, (i * 7) % 5, 0.5 * i]) for i in range(40)] + [(40, "l0", "zero", [0, 0, 0])]
    c = emb_corpus(spark, rows)
    queries = [(i, f"q{i}", [3.0 * (i + 1), float(i % 2), 2.0]) for i in range(9)]
    q = _queries(spark, queries)
    want = {}
    for qid, _, v in queries:
        sims = [(-round(sum(a * b for a, b in zip(_unit(v), _unit(x))), 6), p % 3, p) for p, _, _, x in rows[:40]]
        want[qid] = [p for s, _, p in sorted(sims)[:5] if -s >= 0.2]
    monkeypatch.setattr(S, "TILE", 2)
    for method in ("broadcast", "blocked"):
        hits = S.search_hits(c.repartition(4), q, 0.2, 5, method=method, tile_bytes=200).collect()
        got = {i: [r.phrase_id for r in sorted(hits, key=lambda r: r.rank) if r.query_id == i] for i in want}
        assert got == want
    assert S.search_hits(c, q, 0.2, 5, broadcast_bytes=0).count() == sum(map(len, want.values()))
