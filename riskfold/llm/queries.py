"""Queries of this subpackage and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from riskfold.llm import bpe, langid, lexical, packing, pii, quality, quality_model, secrets, simhash, spelling, tokens, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_topk": topk.op5_topk,
    "op6_secrets": secrets.op6_secrets,
    "op7_packing": packing.op7_packing,
    "op8_language_id": langid.op8_language_id,
    "op10_token_output": tokens.op10_token_output,
    "op9_quality_rules": quality.op9_quality_rules,
    "op11_quality_classifier": quality_model.op11_quality_classifier,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op5_topk": topk.SQL,
    "op9_quality_rules": quality.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_spelling_variants": spelling.SQL,
}
