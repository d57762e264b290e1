import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscope.llm.packing import _exact, pack_documents, plan, slots
from corpuscope.llm.queries_files import tokenizer_path

SCHEMA = "doc_id long, text string, length string, RID int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), max_size=30))
def test_plan_places_every_piece_once(histogram):
    groups, used = plan(histogram, 60), Counter()
    for n, held in groups:
        assert n > 0 and sum(x * k for x, k in held) <= 60
        for x, k in held:
            used[x] += n * k
    assert used == Counter(histogram)
    spans = defaultdict(list)
    for length, lo, hi, *_ in slots(groups):
        spans[length].append((lo, hi))
    for length, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(s, s[1:]))


@pytest.mark.parametrize("lengths, slack", [
    (np.clip(np.random.default_rng(1).lognormal(6, 1, 50_000).astype(int), 1, 4096), 1.001),
    (np.random.default_rng(2).integers(1, 4097, 20_000), 1.01), (np.ones(100_000, int), 1.0)])
def test_plan_is_close_to_the_lower_bound(lengths, slack):
    assert sum(n for n, _ in plan(Counter(lengths.tolist()))) <= slack * -(-int(lengths.sum()) // 4096) + 1


def test_exact_complements():
    assert sorted(n for n, _ in plan({30: 5, 70: 5}, 100)) == [5]
    assert plan({50: 3, 25: 6}, 100) and sum(n for n, _ in plan({50: 3, 25: 6}, 100)) == 3
    assert sum(n for n, _ in plan({40: 1, 31: 1, 20: 1, 9: 1}, 100)) == 1


def test_a_triple_behind_many_longer_lengths():
    groups = plan({2096: 1, 700: 1, 680: 1, 620: 1, **{x: 1 for x in range(1001, 1101)}}, 4096)
    assert (1, [(2096, 1), (700, 1), (680, 1), (620, 1)]) in groups


def test_exact_finds_a_combination_whenever_there_is_one():
    rnd = np.random.default_rng(4)
    for _ in range(400):
        count = np.zeros(61, np.int64)
        for x in rnd.integers(1, 61, rnd.integers(1, 9)):
            count[x] += 1
        gap, held = int(rnd.integers(2, 61)), count.copy()
        ways = [c for k in (1, 2, 3) for c in combinations_with_replacement(np.flatnonzero(count).tolist(), k)
                if sum(c) == gap and all(count[x] >= c.count(x) for x in c)]
        found = _exact(gap, count)
        assert (tuple(sorted(found)) in ways if ways else found is None) and (count == held).all()


def test_sequences_of_documents(spark):
    rows = [(i, " ".join(f"w{i * j % 91} word" for j in range(i * 13 % 700)), "x", 1) for i in range(150)]
    rows += [(900, None, "", 0), (901, "", "", 0), (None, "null id", "", 0), (902, "long text " * 9000, "", 0), rows[7], rows[7]]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer_path(), 1, 512, with_ids=True).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc_id, k, at, len(ids[at:at + 512]), zlib.crc32(np.array(ids[at:at + 512], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        ends = np.cumsum([0] + [n for _, n in pieces])
        assert [o for o, _ in pieces] == ends[:-1].tolist() and ends[-1] <= 512
    assert len(by) <= 1.02 * sum(w[3] for w in want) / 512 + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path(), 1).collect() == []


def test_columns_with_names_of_helpers(spark):
    from corpuscope.llm.packing import pack

    rows = [(10, f"r{i}", i, i, -i, 0.5, i, i) for i in range(7)]
    pieces = spark.createDataFrame(rows, "length long, RID string, chunk int, own int, rank int, lo double, first int, offset int")
    got = pack(pieces, 30).collect()
    assert sorted((r.RID, r.chunk, r.own, r["rank"], r.lo, r["first"]) for r in got) == sorted((r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == 7 and len({r.sequence_id for r in got}) == 3
