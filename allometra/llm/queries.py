"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from allometra.llm import oracles, quality_model, toxicity
from allometra.llm.collocations import collocations
from allometra.llm.common import table
from allometra.llm.decontaminate import find_leaks
from allometra.llm.divergence import audit
from allometra.llm.jaccard_join import duplicate_components
from allometra.llm.page_text import extract
from allometra.llm.paragraph_dedup import repeated_paragraphs
from allometra.llm.quality_rules import BASE_MEASURES, score_documents
from allometra.llm.secret_scan import secret_report
from allometra.llm.source_mix import mix
from allometra.llm.token_pack import pack
from allometra.llm.tool_calls import format_conversations


def op1_chat_format(spark, sf_dir):
    return format_conversations(table(spark, sf_dir, "conversations"))


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op4_paragraph_dedup(spark, sf_dir):
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op5_token_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op8_jaccard_join(spark, sf_dir):
    return duplicate_components(table(spark, sf_dir, "documents"), size=3, similarity=(9, 10))


def op9_quality_rules(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", *BASE_MEASURES, "base_failed", "kept")


def op10_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.training_sample(documents, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(documents, model)


def op11_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality_model.score_documents(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_html_extraction,
        op3_secret_scan,
        op4_paragraph_dedup,
        op5_token_pack,
        op6_decontamination,
        op7_source_mix,
        op8_jaccard_join,
        op9_quality_rules,
        op10_toxicity,
        op11_source_divergence,
        op12_quality_classifier,
        op13_phrase_collocations,
    )
}
ORACLES = {
    "op7_source_mix": oracles.SOURCE_MIX,
    "op9_quality_rules": oracles.QUALITY_RULES,
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op13_phrase_collocations": oracles.COLLOCATIONS,
}
