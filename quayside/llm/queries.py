"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quayside.llm import crossentropy, divergence, html, language, lexical, mixing, pieces, quality, repetition, simhash, topk, toxicity, vectors

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_quality_crf": quality.op2_quality_crf,
    "op3_quality_rules": repetition.op3_quality_rules,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_cross_entropy": crossentropy.op5_cross_entropy,
    "op6_top_k": topk.op6_top_k,
    "op7_html_main_text": html.op7_html_main_text,
    "op8_simhash_near_dup": simhash.op8_simhash_near_dup,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_embedding_near_dup": vectors.op11_embedding_near_dup,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_top_k": topk.OP6_SQL,
    "op3_quality_rules": repetition.OP3_SQL,
    "op11_embedding_near_dup": vectors.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
