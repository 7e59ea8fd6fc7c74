"""The corpus queries by name, and their SQL where SQL can say the same."""

from linewright.llm import (
    chat_format,
    exact_dedup,
    hard_negatives,
    html_text,
    language_id,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    source_mix,
    top_k,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_html_text": html_text.query,
    "op3_near_dedup": near_dedup.query,
    "op4_packing": packing.query,
    "op5_url_filter": url_filter.query,
    "op6_top_k": top_k.query,
    "op7_chat_format": chat_format.query,
    "op8_quality_model": quality_model.query,
    "op9_source_mix": source_mix.query,
    "op10_language_id": language_id.query,
    "op11_whitening": whitening.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_top_k": top_k.SQL,
    "op7_chat_format": chat_format.SQL,
    "op9_source_mix": source_mix.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
