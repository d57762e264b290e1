import random
import re
from collections import Counter, defaultdict

from corpuscope.llm import phrase_graph
from corpuscope.llm.phrase_graph import collocations, compact_paths, order_one, node_flow

SCHEMA = "doc_id long, text string, lang string, GRAM string, n int"


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for ws in words_of(text):
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cands = [p for p, c in counts.items() if len(p) > 1 and c >= least]
        best = Counter()
        for p in cands:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    best[p[i:i + k]] = max(best[p[i:i + k]], counts[p])
        scored = []
        for p in cands:
            a = counts[p]
            if p in best and 100 * best[p] >= cover * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def found(df):
    rows = df.collect()
    assert len(set(map(tuple, rows))) == len(rows)
    return set(map(tuple, rows))


def corpus(seed, docs):
    rnd = random.Random(seed)
    vocab = ["The", "of", "Éa", "\x00", "a\u00a0b", "é", "tea", "cup", "New", "York", "x y", "日本", "a", "-", "😀"]
    fixed = ["new york tea cup of the day", "the the the the the", "a b c a b c a b c a b c a b c a b", " ".join(f"w{i}" for i in range(60))]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rnd.randrange(0, 8)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.3 else " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 9))))
            parts.append(rnd.choice([".", ", ", "\n", "\t", "  ", "; ", "!?", "\r\n"]))
        rows.append((i, "".join(parts), rnd.choice(["en", "en", "en", "de", None, "und", ""]), "g", 1))
    return rows + [(900, None, "en", None, 0), (901, "", "en", "", 0), (None, "only . , here", "xx", "", 0), rows[3], rows[3]]


def test_against_all_counts(spark, monkeypatch):
    rows = corpus(2, 160)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(collocations(frame, 6, 80, 25)) == brute(rows, 6, 80, 25)
    monkeypatch.setattr(phrase_graph, "PAIR_BITS", 64)  # a map that is full changes nothing
    monkeypatch.setattr(phrase_graph, "SEGMENT", 4)
    monkeypatch.setattr(phrase_graph, "CHUNK_BYTES", 300)
    assert found(collocations(frame, 3, 50, 1000)) == brute(rows, 3, 50, 1000)


def test_node_flow_is_the_count(spark):
    rows = corpus(5, 60)
    got = {(r.lang, r.gram): r.n for r in node_flow(order_one(spark.createDataFrame(rows, SCHEMA)), 1).collect()}
    want = Counter(("und" if lang is None else lang, w) for _, t, lang, *_ in rows for ws in words_of(t) for w in ws)
    assert got == dict(want)


def edges_of(*lines):
    out = Counter()
    for line in lines:
        ws = line.split()
        for i in range(len(ws) - 3):
            out["en", " ".join(ws[i:i + 4])] += 1
    return [(lang, gram, n) for (lang, gram), n in out.items()]


def test_paths(spark, monkeypatch):
    long = [f"w{i}" for i in range(100)]
    rows = edges_of(" ".join(long), "p q r s t", "p q r z", "a b c d e a b c d e a b c", "o o o o")
    paths = compact_paths(spark.createDataFrame(rows, "lang string, gram string, n long")).collect()
    edges = Counter()
    for p in paths:
        assert len(p.nodes) == len(p.weights) + 1
        for a, b, w in zip(p.nodes, p.nodes[1:], p.weights):
            assert a.split()[1:] == b.split()[:2]
            edges[p.lang, a + " " + b.split()[-1]] = w
    assert edges == Counter({(lang, gram): n for lang, gram, n in rows})  # every edge once
    assert sorted(len(p.weights) for p in paths) == [1, 1, 2, 5, 97]
    assert {p.head for p in paths if len(p.weights) == 5} == {"a b c d"}  # a cycle opens at its least edge
    monkeypatch.setattr(phrase_graph, "SEGMENT", 10)
    cut = compact_paths(spark.createDataFrame(rows, "lang string, gram string, n long")).where("head = 'w0 w1 w2 w3'").collect()
    assert [len(p.weights) for p in sorted(cut, key=lambda p: p.segment)] == [10] * 9 + [7]


def test_empty_and_long(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "big data " * 200_000
    got = found(collocations(spark.createDataFrame([(1, text, "en", "", 0)], SCHEMA)))
    assert got == brute([(1, text, "en")], 30, 80, 2000)
    assert collocations(spark.createDataFrame([(1, "x" * 3_000_000, "en", "", 0)], SCHEMA)).collect() == []
