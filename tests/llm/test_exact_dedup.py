import hashlib
import re

import pytest

from corpuscope.llm.exact_dedup import drop_exact_duplicates, exact_groups

SCHEMA = "doc_id long, text string, KEEP_ID string, text_sha256 int"


def brute(rows):
    key = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, *_ in rows]
    groups = {}
    for k, r in zip(key, rows):
        groups.setdefault(k, []).append(r[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], first[k], len(groups[k]), k) for k, r in zip(key, rows)), key=str)


ROWS = ([(i, "hot  text\there", "x", 1) for i in range(100, 160)] + [(i, f"own {i}", None, None) for i in range(30)]
        + [(200, "a\tb", "q", 3), (7, "a b", "q", 3), (201, "a \n b", None, 3), (202, " a b", "", 3), (203, "a b", "", 3)]
        + [(300, None, "x", 1), (301, "", "x", 1), (None, "", "x", 1), (None, None, None, None)]
        + [(400, "twice", "x", 1), (400, "twice", "x", 1), (None, "lone", "y", 2), (500, "z" * 300_000, "", 0)])


@pytest.mark.parametrize("support", [1 / 1024, 0.05])
def test_groups_match_brute_force(spark, support):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = exact_groups(df, support=support).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("support", [1 / 1024, 0.05])
def test_drop_keeps_one_row_and_every_column(spark, support):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    out = drop_exact_duplicates(df, support=support)
    assert out.columns == df.columns
    rows = out.collect()
    want = {(b[1], b[3]) for b in brute(ROWS)}
    got = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in rows]
    assert len(got) == len(want) and set(got) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).collect() == [] and drop_exact_duplicates(df).collect() == []
