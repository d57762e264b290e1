import numpy as np

from conftest import emb_corpus
from corpuscope.operators import similarity as S


def _pairs(df):
    return sorted((r.phrase_id, r.other_id) for r in df.collect())


def test_identical_phrases_across_intents_conflict(spark):       # A10
    c = emb_corpus(spark, [(0, "a", "hello", [1, 0]), (1, "b", "hello", [1, 0])])
    rows = S.phrase_conflicts(c, method="plain").collect()
    assert len(rows) == 1 and rows[0].sim == 1.0 and rows[0].is_exact


def test_same_intent_never_conflicts(spark):                      # A12
    c = emb_corpus(spark, [(0, "a", "same", [1, 0]), (1, "a", "same", [1, 0])])
    assert S.phrase_conflicts(c, method="plain").count() == 0


def _random_corpus(spark, n=20, d=4, seed=42):
    rs = np.random.RandomState(seed)
    v = rs.randn(n, d).astype("float32")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return emb_corpus(spark, [(i, "a" if i < n // 2 else "b", f"p{i}", v[i]) for i in range(n)])


def test_cap_honoured_and_flag(spark):                             # A11, B9
    c = _random_corpus(spark)
    allc = S.phrase_conflicts(c, threshold=-1.0, method="plain")
    total = allc.count()
    capped = S.cap_conflicts(allc, 2)
    assert capped.count() <= 2 and all(r.limit_reached for r in capped.collect())
    assert all(r.limit_reached for r in S.cap_conflicts(allc, total).collect())      # exactly N → reached
    assert not any(r.limit_reached for r in S.cap_conflicts(allc, total + 1).collect())


def test_threshold_is_inclusive(spark):                            # B6
    c = emb_corpus(spark, [(0, "a", "x", [1, 0]), (1, "b", "y", [0.7, np.sqrt(1 - 0.49)])])
    assert S.phrase_conflicts(c, threshold=0.7, method="plain").count() == 1


def test_blocked_equals_plain(spark):                              # §5 invariant
    c = _random_corpus(spark, n=60, d=8)
    a = _pairs(S.phrase_conflicts(c, 0.2, method="plain"))
    b = _pairs(S.phrase_conflicts(c, 0.2, method="blocked", block_rows=7))
    assert a == b and len(a) > 0


def test_topk_with_all_neighbours_equals_exact(spark):             # SIM-6 ⊆ SIM-5, k=n
    c = _random_corpus(spark, n=40, d=6)
    exact = _pairs(S.phrase_conflicts(c, 0.2, method="plain"))
    assert _pairs(S.conflicts_topk(c, 0.2, k=40, block_rows=9)) == exact
    small = _pairs(S.conflicts_topk(c, 0.2, k=3, block_rows=9))
    assert set(small) <= set(exact)


def test_topk_misses_pair_hidden_by_own_label(spark):              # B8, T-15
    rows = [(0, "a", "q", [1, 0, 0]), (1, "a", "n1", [0.99, 0.14, 0]), (2, "a", "n2", [0.98, 0.2, 0]),
            (3, "a", "n3", [0.97, 0.24, 0]), (4, "b", "far", [0.9, 0, 0.43])]
    c = emb_corpus(spark, rows)
    assert (0, 4) in _pairs(S.phrase_conflicts(c, 0.7, method="plain"))
    assert (0, 4) not in _pairs(S.conflicts_topk(c, 0.7, k=3))


def test_lsh_is_subset_of_exact(spark):                            # SIM-7 ⊆ SIM-5
    c = _random_corpus(spark, n=60, d=8)
    exact = set(_pairs(S.phrase_conflicts(c, 0.5, method="plain")))
    assert set(_pairs(S.conflicts_lsh(c, 0.5))) <= exact


def test_zero_vector_has_zero_similarity(spark):                   # B16
    c = emb_corpus(spark, [(0, "a", "z", [0, 0]), (1, "b", "y", [1, 0])])
    assert S.phrase_conflicts(c, threshold=-0.5, method="plain").collect()[0].sim == 0.0


def test_partition_count_independent(spark):                       # §5 invariant
    c = _random_corpus(spark, n=50, d=5)
    base = _pairs(S.phrase_conflicts(c, 0.3, method="blocked", block_rows=8))
    assert base == _pairs(S.phrase_conflicts(c.repartition(5), 0.3, method="blocked", block_rows=8))


def test_matrix_and_pairs(spark):
    c = emb_corpus(spark, [(0, "a", "x", [1, 0]), (1, "a", "y", [1, 0]), (2, "b", "z", [0.8, 0.6])])
    m = S.intent_matrix(S.intent_centroids(c))
    assert m.count() == 4
    p = S.confusing_pairs(m, 0.5).collect()
    assert len(p) == 1 and abs(p[0].sim - 0.8) < 1e-9 and p[0].risk == "Medium"
    assert S.confused_with(S.confusing_pairs(m, 0.5), "b").collect()[0].other_intent == "a"


def test_cap_inside_blocks_equals_global_cap(spark):               # SIM-9 with the in-kernel cap
    c = _random_corpus(spark, n=80, d=4, seed=7)
    full = S.phrase_conflicts(c, 0.0, method="plain", max_conflicts=None)
    want = [(r.phrase_id, r.other_id) for r in
            full.orderBy("intent_pos", "row_pos", "other_pos", "other_row").limit(25).collect()]
    got = [(r.phrase_id, r.other_id) for r in
           S.phrase_conflicts(c, 0.0, method="blocked", block_rows=9, max_conflicts=25)
           .orderBy("intent_pos", "row_pos", "other_pos", "other_row").collect()]
    assert got == want


def test_hot_duplicate_group_stays_bounded(spark):                 # a third of rows identical
    rows = [(i, "a" if i % 3 else "b", "same text", [1, 0]) for i in range(60)]
    c = emb_corpus(spark, rows)
    capped = S.phrase_conflicts(c, 0.9, method="blocked", block_rows=8, max_conflicts=30)
    assert capped.count() == 30
    pairs = S.exact_duplicates(c.drop("embedding"))
    assert pairs.count() == 800 == pairs.select("phrase_id", "other_id").distinct().count()   # 20 rows of b × 40 of a
    star = S.duplicate_groups(c.drop("embedding"))
    assert star.count() == 40            # label b comes first (row 0); each of the 40 repeats in a, once


def test_chunked_kernels_match_plain(spark, monkeypatch):          # chunk × block products
    monkeypatch.setattr(S, "CHUNK_ROWS", 3)
    c = _random_corpus(spark, n=50, d=5, seed=3)
    plain = _pairs(S.phrase_conflicts(c, 0.1, method="plain", max_conflicts=None))
    assert _pairs(S.phrase_conflicts(c, 0.1, method="blocked", block_rows=11, max_conflicts=None)) == plain
    first = [(r.phrase_id, r.other_id) for r in S.phrase_conflicts(c, 0.1, method="plain", max_conflicts=17)
             .orderBy("intent_pos", "row_pos", "other_pos", "other_row").collect()]
    got = [(r.phrase_id, r.other_id) for r in S.phrase_conflicts(c, 0.1, method="blocked", block_rows=11,
                                                                 max_conflicts=17)
           .orderBy("intent_pos", "row_pos", "other_pos", "other_row").collect()]
    assert got == first
    assert _pairs(S.conflicts_topk(c, 0.1, k=50, block_rows=11, max_conflicts=None)) == plain


def test_lsh_recall_on_planted_near_duplicates(spark):             # SIM-7 recall
    rs = np.random.RandomState(11)
    base = rs.randn(40, 16)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noisy = base + 0.08 * rs.randn(40, 16)
    rows = [(i, "a", f"p{i}", base[i]) for i in range(40)] + [(40 + i, "b", f"q{i}", noisy[i]) for i in range(40)]
    c = emb_corpus(spark, rows)
    exact = set(_pairs(S.phrase_conflicts(c, 0.9, method="plain", max_conflicts=None)))
    found = set(_pairs(S.conflicts_lsh(c, 0.9, max_conflicts=None)))
    assert found <= exact and len(exact) >= 40 and len(found) >= 0.9 * len(exact)


def test_registered_lsh_recall_against_all_conflicts(spark):       # SIM-7 recall of the registered query
    from corpuscope.plans.q_similarity import q_conflicts_lsh, q_phrase_conflicts

    sf = "/root/testdata/sf0.01"
    every, found = ({(r.phrase_id, r.other_id) for r in q(spark, sf).select("phrase_id", "other_id").collect()}
                    for q in (q_phrase_conflicts, q_conflicts_lsh))
    assert found <= every and len(every) > 500
    assert len(found) >= 0.9 * len(every), f"{len(found)} of {len(every)}"


def test_lsh_probes_nearest_buckets():
    rs = np.random.RandomState(2)
    unit, planes = rs.randn(50, 16), rs.randn(13, 16)
    z = unit @ planes.T
    code, near = S._codes(unit, planes, 40)
    for r in range(50):
        flipped = [[b for b in range(13) if (code[r] ^ m) >> b & 1] for m in near[r]]
        costs = [sum(z[r, b] ** 2 for b in f) for f in flipped]
        weakest = set(np.argsort(z[r] ** 2)[:S.WEAK_BITS])
        every = sorted(sum(z[r, b] ** 2 for j, b in enumerate(sorted(weakest)) if m >> j & 1) for m in range(1 << S.WEAK_BITS))
        assert code[r] in near[r] and np.allclose(sorted(costs), every[:40]) and all(set(f) <= weakest for f in flipped)


def test_lsh_groups_and_hot_vectors(spark):                       # the same pairs with tiles of a few rows
    c = _random_corpus(spark, n=90, d=8)
    rows = [(200 + i, "c" if i % 2 else "d", "hot", [1.0] * 8) for i in range(30)]
    c = c.union(emb_corpus(spark, rows))
    whole = _pairs(S.conflicts_lsh(c, 0.5))
    assert _pairs(S.conflicts_lsh(c, 0.5, tile_bytes=800)) == whole and len(whole) > 225


def test_registered_lsh_makes_fewer_comparisons(spark):           # against all cross-label pairs at sf0.1
    from corpuscope.plans import params as P
    from corpuscope.plans.q_similarity import prepared_corpus, q_conflicts_lsh, q_phrase_conflicts

    sf = "/root/testdata/sf0.1"
    corpus = prepared_corpus(spark, sf)
    n = corpus.count()
    sizes = [r["count"] for r in corpus.groupBy("intent").count().collect()]
    exact = (n * n - sum(s * s for s in sizes)) / 2
    compared = S.lsh_pairs(corpus, -2.0, "embedding", P.LSH_TABLES, P.LSH_SHARE, P.LSH_PROBES, 42, S.TILE_BYTES).count()
    assert compared < 0.75 * exact, compared / exact
    assert q_conflicts_lsh(spark, sf).count() >= 0.9 * q_phrase_conflicts(spark, sf).count()
