import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpuscope.llm import components, near_dedup, shingles
from corpuscope.llm import hyperminhash as hmh
from corpuscope.llm.components import connected_components
from corpuscope.llm.near_dedup import drop_near_duplicates, near_groups

SCHEMA = "doc_id long, text string, component_id string, REGS int"


def shingle_strings(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows):
    """(doc_id, n_shingles, component_id) by an inverted index over every shingle."""
    sets = [shingle_strings(t) for _, t, *_ in rows]
    distinct = {}
    for i, s in enumerate(sets):
        distinct.setdefault(s, []).append(i)
    keys = [s for s in distinct if s]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(keys):
        shared = defaultdict(int)
        for g in s:
            for j in index[g]:
                shared[j] += 1
            index[g].append(i)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(keys[j]) - both):
                root[find(i)] = find(j)
    comp = defaultdict(list)
    for i, s in enumerate(keys):
        comp[find(i)] += distinct[s]
    out = {}
    for members in comp.values():
        least = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
        out.update({m: least for m in members})
    return sorted(((r[0], len(sets[i]), out.get(i, r[0])) for i, r in enumerate(rows)), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "straße", "日本"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, rows = text(60), []
    for base in range(25):
        words = text(rnd.choice([5, 6, 8, 12, 30, 80, 300])).split()
        for copy in range(rnd.choice([1, 2, 6, 25])):
            new = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, len(new) // 25])):
                new[rnd.randrange(len(new))] = rnd.choice(vocab)
            rows.append(" \n".join(new) if copy % 3 else " ".join(new).upper().replace("SSE", "sse"))
    rows += [passage + " " + text(rnd.randrange(5, 90)) for _ in range(150)]
    rows += [None, "", " \t\n", "one", "one", "ONE  ", "two words", "a b c d e", "a b c d", text(30_000)]
    rnd.shuffle(rows)
    out = [(i * 3 + 1, t, "x", 0) for i, t in enumerate(rows)]
    return out + [(None, passage, None, None), (None, "", None, None), out[5], (out[9][0], "other text with this id again", "", 1)]


@pytest.mark.parametrize("block", [7, near_dedup.BLOCK])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    got = near_groups(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_match_brute_force_on_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = near_groups(spark.read.parquet(path)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_isolated_pairs_at_the_threshold(spark):
    rows, unions = [], {}
    for shared, own_a, own_b in [(3, 0, 1), (6, 1, 1), (9, 1, 2), (12, 2, 2), (18, 3, 3)]:
        for n in range(40):
            word = f"p{len(rows)}n"
            both = [f"{word}{i}" for i in range(shared + 4)]
            for side, own in (("a", own_a), ("b", own_b)):
                unions[len(rows)] = shared + own_a + own_b
                rows.append((len(rows), " ".join(both + [f"{word}{side}{i}" for i in range(own)]), "x", 0))
    got = near_groups(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    lost = [unions[r.doc_id] for r in got if r.doc_id % 2 and r.kept]
    assert lost == []
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_drop_keeps_one_of_each_component(spark):
    rows = [r for r in corpus(2) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.collect())
    want = sorted(d for d, n, c in brute(rows) if d == c)
    # a row repeated as a whole stays with its copy; a second text of the same id goes with its own component
    assert sorted(set(kept)) == sorted(set(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_groups(df).collect() == [] and drop_near_duplicates(df).collect() == []


def test_pieces_of_long_texts_give_the_same_set(monkeypatch):
    text = " ".join(f"w{i % 977} x{i % 13}" for i in range(5000)).encode()
    (whole,) = shingles.shingle_sets([text])
    monkeypatch.setattr(shingles, "PIECE_BYTES", 500)
    for got in shingles.shingle_sets([text, b"", None, text]):
        assert len(got) in (0, len(whole)) and (len(got) == 0 or (got == whole).all())


def test_estimate_is_close_and_corrected():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2)
    for n, shared in [(4000, 3600), (4000, 2000), (20_000, 0), (300, 280)]:
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:shared], pool[20_000:20_000 + n - shared])))
        regs = hmh.sketch([a, b])
        est, used = hmh.similarity(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))
        true = shared / (2 * n - shared)
        assert abs(est[0] - true) < 0.15 and used[0] > 100


@pytest.mark.parametrize("one_partition", [0, components.ONE_PARTITION_LINKS])
def test_components_of_paths_and_stars(spark, monkeypatch, one_partition):
    monkeypatch.setattr(components, "ONE_PARTITION_LINKS", one_partition)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 60)] + [(300, 301), (301, 300), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{j: 1 for j in range(1, 60)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_clashing_helper_names(spark):
    from corpuscope.llm.near_dedup import drop_near_duplicates

    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words, "a", 1), (2, words + " more", "b", 2), (3, "other text", None, None)],
                                 "doc_id long, text string, Drop_Key string, COMP int")
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [1, 3]


def test_sketches_hold_a_run_of_texts_at_once():
    import pyarrow as pa

    texts = [b"x" * 300_000] * 40 + [b""] * 3 + [b"y" * 5_000_000, b"z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "body": texts})
    runs = list(near_dedup._pieces(batch))
    assert [i for r in runs for i in r.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(r.num_rows == 1 or sum(map(len, r.column("body").to_pylist()[1:])) <= near_dedup.SKETCH_BYTES for r in runs)
    assert not list(near_dedup._pieces(batch.slice(0, 0)))
