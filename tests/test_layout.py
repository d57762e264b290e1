import numpy as np

from conftest import emb_corpus
from corpuscope.operators import layout2d as L
from corpuscope.operators import project2d as D


def _clusters(spark, n, d=16, clusters=20, seed=0):
    rs = np.random.RandomState(seed)
    centre = rs.randn(clusters, d)
    which = rs.randint(clusters, size=n)
    return emb_corpus(spark, [(i, f"l{which[i]}", f"p{i}", centre[which[i]] + 0.6 * rs.randn(d)) for i in range(n)]), which


def test_layout_keeps_more_neighbours_than_pca(spark):
    corpus, _ = _clusters(spark, 400)
    xy, graph = L.neighbour_layout(corpus)
    kept, pca = L.neighbours_kept(graph, xy), L.neighbours_kept(graph, D.pca_2d(corpus).select("phrase_id", "x", "y"))
    assert kept > 0.4 and kept > 2 * pca, (kept, pca)
    again, _ = L.neighbour_layout(corpus.repartition(5), rounds=3)
    once, _ = L.neighbour_layout(corpus, rounds=3)
    a, b = (np.array(sorted(map(tuple, f.collect()))) for f in (again, once))
    assert np.allclose(a, b, atol=1e-6)


def test_graph_is_symmetric_and_sums_to_one(spark):
    corpus, _ = _clusters(spark, 60, clusters=4)
    p = np.zeros((60, 60))
    for r in L.neighbour_graph(corpus, k=5).collect():
        p[r.i, r.others] = r.p
        assert len(r.nearest) == 5 and r.i not in r.nearest
    assert np.allclose(p, p.T) and abs(p.sum() - 1) < 1e-9


def test_every_phrase_is_placed(spark):
    corpus, which = _clusters(spark, 300, clusters=5, seed=3)
    rows = L.layout_2d(corpus, cap=100, rounds=25).collect()
    assert sorted(r.phrase_id for r in rows) == list(range(300))
    xy = np.array([[r.x, r.y] for r in sorted(rows, key=lambda r: r.phrase_id)])
    own = np.mean([np.linalg.norm(xy[which == c] - xy[which == c].mean(axis=0), axis=1).mean() for c in range(5)])
    assert own < 0.5 * np.linalg.norm(xy - xy.mean(axis=0), axis=1).mean()   # clusters stay together
    for n in (0, 1, 2):
        assert L.layout_2d(corpus.where(f"phrase_id < {n}"), rounds=2).count() == n


def test_landmarks_beyond_the_broadcast_stream(spark):             # DIM-3
    corpus, _ = _clusters(spark, 200, d=6)
    lm = D.landmark_sample(corpus, 60).selectExpr("phrase_id", "embedding", "embedding[0] as x", "embedding[1] as y")
    a = {r.phrase_id: (r.x, r.y) for r in D.landmark_place(corpus, lm).collect()}
    b = {r.phrase_id: (r.x, r.y) for r in D.landmark_place(corpus, lm, broadcast_bytes=2000).collect()}
    assert a.keys() == b.keys() and len(a) == 140 and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)
