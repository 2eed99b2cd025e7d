"""The operators on training data as queries over the given tables."""

from evalgrid.llm import (
    context_tree,
    conversation_repair,
    decontamination,
    html_text,
    language_id,
    near_duplicates,
    packing,
    personal_data,
    quality,
    rotated_codes,
    spelling,
    token_counts,
    url_filter,
)

QUERIES = {
    "op1_context_tree": context_tree.op1_context_tree,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_html_text": html_text.op4_html_text,
    "op5_language_id": language_id.op5_language_id,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_rotated_codes": rotated_codes.op7_rotated_codes,
    "op8_jaccard_join": near_duplicates.op8_jaccard_join,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_survivor_viterbi": conversation_repair.op11_survivor_viterbi,
    "op12_prefix_suffix_tiles": spelling.op12_prefix_suffix_tiles,
    "op13_bootstrapped_contexts": personal_data.op13_bootstrapped_contexts,
}

ORACLES = {
    "op6_decontamination": decontamination.SQL,
    "op10_url_filter": url_filter.SQL,
}
