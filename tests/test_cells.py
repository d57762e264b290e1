import numpy as np
import pyarrow as pa

from conftest import emb_corpus
from corpuscope.operators import cells as C
from corpuscope.operators import similarity as S


def _pairs(df):
    return sorted((r.phrase_id, r.other_id, r.sim) for r in df.collect())


def clustered(spark, n, d, clusters, noise, seed=5, hot=0.0, extra=()):
    """Vectors around a few directions; ``hot`` of them equal; two labels."""
    rs = np.random.RandomState(seed)
    centre = rs.randn(clusters, d)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = centre[rs.randint(clusters, size=n)] + noise * rs.randn(n, d) / np.sqrt(d)
    v[: int(hot * n)] = centre[0]
    rows = [(i, "abc"[rs.randint(3)], f"p{i}", v[i] * rs.uniform(0.5, 2)) for i in range(n)]
    return emb_corpus(spark, rows + list(extra))


def test_conflicts_equal_plain(spark):
    for corpus, t in ((clustered(spark, 300, 6, 12, 0.3, extra=[(900, "a", "z", np.zeros(6)), (901, "b", "z", np.zeros(6))]), 0.8),
                      (clustered(spark, 200, 8, 200, 1.0, seed=2), 0.2), (clustered(spark, 90, 3, 5, 0.1, hot=0.4), 0.95),
                      (clustered(spark, 60, 3, 60, 1.0, extra=[(900, "a", "z", np.zeros(3))]), -0.5)):
        plain = _pairs(S.phrase_conflicts(corpus, t, method="plain"))
        assert len(plain) > 0
        assert [p[:2] for p in _pairs(S.phrase_conflicts(corpus, t))] == [p[:2] for p in plain]
        tiny = _pairs(S.phrase_conflicts(corpus, t, tile_bytes=1500))  # a few rows per tile
        assert [p[:2] for p in tiny] == [p[:2] for p in plain]
        assert np.allclose([p[2] for p in tiny], [p[2] for p in plain], atol=2e-6)


def test_bounds_hold_for_every_pair(spark):
    corpus = clustered(spark, 250, 5, 10, 0.4, hot=0.1, extra=[(900, "a", "z", np.zeros(5))])
    cells = S.conflict_cells(corpus)
    rows = cells.rows.collect()
    u, cell = C.unit_rows(np.array([r.v for r in rows])), np.array([r.cell for r in rows])
    sims = u @ u.T
    assert (sims <= cells.upper[cell[:, None], cell[None, :]] + 1e-9).all()
    assert (sims <= cells.upper_for(u)[:, cell] + 1e-9).all()
    assert cells.count.sum() == len(rows) and cells.count[-1] == 1


def test_clustered_vectors_skip_most_pairs(spark):
    cells = S.conflict_cells(clustered(spark, 3000, 16, 40, 0.1))
    plan = S.conflict_plan(cells, 0.9)
    assert plan["cell_pairs_skipped"] > 0.8 and plan["row_pairs_skipped"] > 0.8, plan


def test_copies_follow_bytes_not_rows(spark):
    """Copies per row are tiles of a fixed number of bytes, and only those a row must meet."""
    n, dim = 10 ** 9, 64
    upper = np.full((101, 101), 1.0)
    cells = C.Cells(spark.range(1), np.eye(100, dim), np.append(np.full(100, n // 100), 0), np.zeros(101), np.zeros(101),
                    np.zeros((101, 1)), np.zeros((101, 1)), dim, 4)
    tiles = C.plan_tiles(cells, 8)
    assert tiles.rows > 100_000 and tiles.total < n / 100_000
    assert C.join_report(cells, tiles, upper >= 0)["copies_per_row"] < n / 8192 / 10


def test_cap_and_empty(spark):
    corpus = clustered(spark, 150, 4, 6, 0.3)
    order = ["intent_pos", "row_pos", "other_pos", "other_row"]
    want = [tuple(r)[:2] for r in S.phrase_conflicts(corpus, 0.5, method="plain").orderBy(*order).limit(40)
            .select("phrase_id", "other_id").collect()]
    got = [tuple(r) for r in S.phrase_conflicts(corpus, 0.5, max_conflicts=40, tile_bytes=1500).orderBy(*order)
           .select("phrase_id", "other_id").collect()]
    assert got == want
    assert S.phrase_conflicts(corpus.where("false"), 0.5).count() == 0


def nearest(corpus, k):
    """Plain k nearest rows by the rounded similarity, then corpus order."""
    rows = corpus.collect()
    u = C.unit_rows(np.array([r.embedding for r in rows]))
    sims = np.round(u @ u.T, 6)
    out = set()
    for i, r in enumerate(rows):
        order = sorted(range(len(rows)), key=lambda j: (-sims[i, j], rows[j].intent_pos, rows[j].row_pos))
        out |= {(r.phrase_id, rows[j].phrase_id) for j in order[:k]}
    return out


def test_nearest_rows(spark):
    for corpus in (clustered(spark, 160, 6, 8, 0.2), clustered(spark, 120, 4, 120, 1.0, hot=0.3, extra=[(900, "a", "z", np.zeros(4))])):
        for k, tile_bytes in ((3, 4000), (17, 1 << 20), (500, 3000)):
            found = S._nearest(S.conflict_cells(corpus), k, tile_bytes)
            w = S.Window.partitionBy("phrase_id").orderBy(S.F.desc("sim"), "jp", "jr")
            top = found.withColumn("rk", S.F.row_number().over(w)).where(S.F.col("rk") <= k)
            assert {(r.phrase_id, r.other_id) for r in top.collect()} == nearest(corpus, k)


def test_topk_equals_all_blocks(spark):
    corpus = clustered(spark, 200, 5, 9, 0.3, hot=0.1)
    a = _pairs(S.conflicts_topk(corpus, 0.6, k=12, tile_bytes=5000))
    b = _pairs(S.conflicts_topk(corpus, 0.6, k=12, method="blocked", block_rows=30))
    assert a == b and len(a) > 50
    assert S.conflicts_topk(corpus.where("false"), 0.6, k=5).count() == 0


def _query_frame(spark, vectors):
    return spark.createDataFrame([(i, f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "query_id long, query string, embedding array<double>")


def test_index_hits_equal_search(spark, tmp_path):
    from corpuscope.operators import search as Q

    corpus = clustered(spark, 400, 6, 12, 0.2, hot=0.2, extra=[(900, "a", "z", np.zeros(6))])
    path = str(tmp_path / "index")
    Q.write_index(corpus, path)
    index = Q.open_index(spark, path)
    rs = np.random.RandomState(3)
    some = [r.embedding for r in corpus.limit(10).collect()]
    q = _query_frame(spark, [*some, *rs.randn(15, 6), np.zeros(6)])
    columns = ("query_id", "rank", "phrase_id", "sim")
    for t, k in ((0.5, 5), (0.2, 40), (0.9, 1000), (-0.4, 7)):
        want = sorted(tuple(r) for r in Q.search_hits(corpus, q, t, k, method="broadcast").select(*columns).collect())
        assert len(want) > 20
        for hits in (Q.search_hits(corpus, q, t, k, index=index), Q.search_hits(corpus, q, t, k, index=index, tile_bytes=500),
                     Q.search_hits(corpus, q, t, k, method="blocked", tile_bytes=3000)):
            assert sorted(tuple(r) for r in hits.select(*columns).collect()) == want


def test_index_reads_few_cells(spark, tmp_path):
    from corpuscope.operators import search as Q

    corpus = clustered(spark, 3000, 16, 50, 0.1)
    Q.write_index(corpus, str(tmp_path / "index"))
    index = Q.open_index(spark, str(tmp_path / "index"))
    some = [r.embedding for r in corpus.limit(3).collect()]
    hits, report = Q.index_hits(index, _query_frame(spark, some), 0.5, 100, probes=2)
    assert hits.count() >= 100 and report["rows_read"] < 0.4 and report["cells_read"] < report["cells"], report
    plan = hits._jdf.queryExecution().toString()
    assert any("cell" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_similarities_are_rounded_in_the_task_as_sql_rounds(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(-1, 1, 3000), rng.integers(-10**7, 10**7, 3000) / 1e7, [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 1.0]])
    x = np.concatenate([x, np.nextafter(x, 2), np.nextafter(x, -2)])
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").selectExpr("i", "round(x, 6) AS y").orderBy("i").collect()
    got = S.round6(x)
    assert [r["y"] for r in want] == got.tolist() and not np.signbit(got[got == 0]).any()
    assert np.isnan(S.round6(np.array([np.nan]))[0])


def test_labels_are_compared_for_near_products_alone(spark):
    """Of a tile's products only those near the threshold are looked at, and pairs are rounded before they leave."""
    rng = np.random.default_rng(6)
    n, dim = 400, 16
    v = rng.normal(size=(n, dim))
    batch = pa.RecordBatch.from_pydict({"id": np.arange(n), "ipos": np.arange(n) % 3, "rpos": np.arange(n), "cell": np.zeros(n, np.int32),
                                        "tile": np.zeros(n, np.int32), "floor": np.zeros(n), "v": list(v)})
    block = C.Block([batch], dim)
    kernel, seen = S._PairKernel(block, 0.5, np.ones((1, 1), bool), None), []
    kernel.once = lambda i, b, j: seen.append(len(i)) or block.tile[i] == b.tile[j]
    found = [r for out in kernel.add(block) for r in zip(*out.to_pydict().values())]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(sims >= 0.5)) if i % 3 < j % 3}
    assert {(p, o) for p, o, _ in found} == want and len(found) == len(want)
    assert all(s == round(s, 6) for *_, s in found) and sum(seen) < n * n // 10
