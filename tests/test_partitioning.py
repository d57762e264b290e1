"""Partition-count independence: registered queries give the same
rows with 1, 4 and 16 shuffle partitions."""

import math

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["wide_compact", "tfidf_terms", "duplicate_phrases", "batch_search", "phrase_conflicts",
         "conflicts_topk", "intent_health", "keyword_overlap", "dedupe_corpus"]


def _rows(df):
    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_for_any_partition_count(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(_rows(q(spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
