"""Corpus pipeline over ``documents``: each stage is written as Parquet and read by the next.

quality -> near-duplicates -> decontamination -> mixing -> packing. Stages keep their operators' own parameters.
"""

from __future__ import annotations

from allometra.llm.common import materialise, table
from allometra.llm.decontaminate import drop_leaks
from allometra.llm.jaccard_join import keep_first
from allometra.llm.quality_rules import keep_documents
from allometra.llm.source_mix import take
from allometra.llm.token_pack import pack


def quality(spark, docs, sf_dir):
    """Documents that every quality rule lets through."""
    return keep_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return keep_first(docs)


def decontamination(spark, docs, sf_dir):
    """Documents in which no benchmark item occurs."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return take(docs)


def packing(spark, docs, sf_dir):
    """Packed sequences of token ids."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mixing),
    ("token_pack", packing),
]

#: Packing tokenises, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; returns the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
