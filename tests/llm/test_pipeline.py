import importlib
import re
from collections import Counter, defaultdict


import corpus_pipeline
from corpuscope.llm import quality_rules as qr
from corpuscope.llm.common import materialize
from corpuscope.llm.source_mix import fit, uniform

from .test_near_dedup import brute as near_brute
from .test_quality_rules import brute as quality_brute

SF = "/root/testdata/sf0.01"


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "packing"]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    text_at = columns.index("text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns
        if name == "quality_rules":
            rules = qr.learn_from(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            kept = {r.doc_id: r.kept for r in qr.quality_verdicts(docs, rules).collect()}
            want = [r for r in rows if not quality_brute(r[0], r[text_at])[-1] and kept[r[0]]]
        elif name == "exact_dedup":
            first = {}
            for r in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[text_at]), r)
            want = list(first.values())
        elif name == "near_dedup":
            comp = {d: c for d, _, c in near_brute([(r[0], r[text_at]) for r in rows])}
            want = [r for r in rows if comp[r[0]] == r[0]]
        else:
            p = {(r.source, r.lang, r.topic): r.p for r in fit(docs).collect()}
            topics = docs.select("doc_id", corpus_pipeline.sample.__globals__["topic"]().alias("t"), uniform(docs.doc_id).alias("u"))
            info = {r.doc_id: (r.t, r.u) for r in topics.collect()}
            want = [r for r in rows if info[r[0]][1] < p[(r[columns.index("source")], r[columns.index("lang")], info[r[0]][0])]]
        got = [tuple(r) for r in out.collect()]
        assert Counter(got) == Counter(want) and 0 < len(got) < len(rows), name
        docs, rows = out, got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows}
    used = defaultdict(int)
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_entry_has_all_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= names




def test_stages_on_nulls_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Drop_Key", F.lit("x")).withColumn("RID", F.col("doc_id"))
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for start in (docs.unionByName(odd), docs.where("false")):
        out = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, out, SF), "test-odd")
            assert out.columns == start.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
        assert bool(pieces) == bool(start.limit(1).count())
