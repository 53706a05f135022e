"""The registered queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from tracewright.llm import decontamination, divergence, exact_dedup, html_extraction, jaccard_join, language_model, licenses, mixing, prefix_trie, quality_classifier, quality_rules, tokens, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_language_model": language_model.op6_language_model,
    "op7_token_ids": tokens.op7_token_ids,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_jaccard_join": jaccard_join.OP1_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
