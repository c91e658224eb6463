"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from touchline.llm import decontamination, hard_negatives, html_text, mixing, near_dedup, perplexity, pii, quality_model, secrets, substring_dedup, token_output, toxicity, whitening

QUERIES = {
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op5_decontamination": decontamination.op5_decontamination,
    "op2_pii": pii.op2_pii,
    "op7_secrets": secrets.op7_secrets,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op6_quality_rules": perplexity.op6_quality_rules,
    "op8_token_output": token_output.op8_token_output,
    "op9_mixing": mixing.op9_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLES = {"op5_decontamination": decontamination.SQL, "op9_mixing": mixing.SQL, "op12_hard_negatives": hard_negatives.SQL}
