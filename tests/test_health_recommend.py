import numpy as np

from conftest import corpus_of, emb_corpus
from corpuscope.functions.bands import Bands
from corpuscope.operators import health as H
from corpuscope.operators import recommend as R
from corpuscope.operators import similarity as S


def test_health_records(spark):                                    # A13
    g = {"hello": [.95, .05], "hi": [.90, .10], "hey": [.85, .15], "good morning": [.92, .08]}
    f = {"bye": [.05, .95], "goodbye": [.10, .90], "see you": [.15, .85], "later": [.08, .92]}
    rows = [(i, "greeting", p, v) for i, (p, v) in enumerate(g.items())]
    rows += [(i + 4, "farewell", p, v) for i, (p, v) in enumerate(f.items())]
    h = H.intent_health(emb_corpus(spark, rows)).collect()
    assert len(h) == 2
    assert all(0 <= r.health_score <= 100 and r.grade in ("Good", "Fair", "Needs Work") for r in h)


def test_closed_form_cohesion_matches_pairwise(spark):             # AGG-4
    rs = np.random.RandomState(1)
    v = rs.randn(30, 5)
    rows = [(i, "a" if i < 20 else "b", f"p{i}", v[i]) for i in range(30)]
    coh = {r.intent: r.cohesion for r in H.cohesion(emb_corpus(spark, rows)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u[:20] @ u[:20].T
    pairwise = sims[np.triu_indices(20, 1)].mean()
    assert abs(coh["a"] - pairwise) < 1e-12


def test_health_edges(spark):                                      # B15
    c = emb_corpus(spark, [(0, "solo", "the", [1, 0])])
    r = H.intent_health(c).first()
    assert r.separation == 0.0 and r.cohesion == 1.0 and r.keyword_diversity == 0.0


def _pairs(spark, sims):
    rows = [(f"a{i}", f"b{i}", i, 100 + i, s) for i, s in enumerate(sims)]
    m = spark.createDataFrame(rows, "intent_a string, intent_b string, a_pos bigint, b_pos bigint, sim double")
    return S.confusing_pairs(m, 0.0)


def test_pair_bands_use_three_decimals(spark):                     # B7, T-9, T-10
    p = _pairs(spark, [0.9004, 0.9204, 0.9206, 0.80])
    risk = {r.intent_a: r.risk for r in p.collect()}
    assert risk["a0"] == "High"
    terms = spark.createDataFrame([], "intent string, term string, intent_pos bigint")
    crit = R.priority_actions(p, terms).collect()
    assert {r.action.split("'")[1] for r in crit} == {"a1", "a2"}          # 0.900 is not CRITICAL
    q = R.quick_actions(p, spark.createDataFrame([], "sim double, intent_pos bigint, row_pos bigint, "
                                                     "other_pos bigint, other_row bigint"), Bands()).first()
    assert q.must_fix == 1 and q.should_fix == 2                            # 0.921 must, 0.920 & 0.900 should


def test_phrase_actions(spark):                                    # REC-4, PF-11
    c = corpus_of(spark, {"a": ["book flight now"], "b": ["book flight later trip"]})
    conf = spark.createDataFrame([(0, (1 << 40), 0.97, "a", "b", "book flight now", "book flight later trip",
                                   0, 0, 1, 0)],
                                 "phrase_id bigint, other_id bigint, sim double, intent string, other_intent string, "
                                 "phrase string, similar_to string, intent_pos bigint, row_pos bigint, "
                                 "other_pos bigint, other_row bigint")
    r = R.phrase_actions(conf, c).first()
    assert r.action == "MOVE or DELETE" and r.common_words == "book, flight"
    assert r.add_to_current == "later, trip" and r.suggestion.startswith("Either move to 'b'")
