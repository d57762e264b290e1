"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet below the shared checkpoint
folder and rereads as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``, extra ones included; the last returns one row per
token piece with its sequence and offset.

Null texts and empty texts fail the quality rules; the operators define the
results of ties, repeated rows and empty tables.
"""

from __future__ import annotations

from corpuscope.llm.common import materialize
from corpuscope.llm.exact_dedup import drop_exact_duplicates
from corpuscope.llm.near_dedup import drop_near_duplicates
from corpuscope.llm.packing import pack_documents
from corpuscope.llm.quality_rules import drop_rejected, learn_from
from corpuscope.llm.queries_files import PACK_END_ID, tokenizer_path
from corpuscope.llm.source_mix import fit, sample


def quality_stage(spark, docs, sf_dir):
    """Operator 7: documents that fail the base rule or the learned list go."""
    return drop_rejected(docs, learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark, docs, sf_dir):
    """Operator 1: of equal texts the one with the smallest id stays."""
    return drop_exact_duplicates(docs)


def near_stage(spark, docs, sf_dir):
    """Operator 3: of each group of near copies the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def mix_stage(spark, docs, sf_dir):
    """Operator 5: documents are sampled by their cell's calibrated probability."""
    return sample(docs, fit(docs))


def pack_stage(spark, docs, sf_dir):
    """Operator 10: token pieces with their sequence and offset."""
    return pack_documents(docs, tokenizer_path(), PACK_END_ID)


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("source_mix", mix_stage), ("packing", pack_stage)]

#: The decision list is learned and the near-duplicate groups are found by sketches: no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
