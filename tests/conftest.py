import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpuscope.session import get_session
    s = get_session("local[*]", 8)
    yield s


def corpus_of(spark, data):
    """{intent: [phrase, ...]} (insertion order = label order) → corpus frame."""
    rows = []
    for ip, (intent, phrases) in enumerate(data.items()):
        for rp, p in enumerate(phrases):
            rows.append(((ip << 40) + rp, intent, ip, rp, p))
    return spark.createDataFrame(rows, "phrase_id bigint, intent string, intent_pos bigint, row_pos bigint, phrase string")


def emb_corpus(spark, rows):
    """rows: (phrase_id, intent, phrase, vector) in label order of first appearance."""
    firsts = {}
    for pid, intent, _, _ in rows:
        firsts.setdefault(intent, pid)
    data = [(pid, intent, firsts[intent], pid, phrase, [float(x) for x in vec]) for pid, intent, phrase, vec in rows]
    return spark.createDataFrame(data, "phrase_id bigint, intent string, intent_pos bigint, row_pos bigint, "
                                       "phrase string, embedding array<double>")
