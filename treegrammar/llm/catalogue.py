"""The queries of this subpackage and the SQL of those that SQL can express."""

from treegrammar.llm import bytepairs, clusters, codes, decontaminate, language, mixing, scoring, simhash, tokens, topk, toxicity, urls

QUERIES = {
    "op1_lm_score": scoring.op1_lm_score,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language_id": language.op3_language_id,
    "op4_url_filter": urls.op4_url_filter,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_token_output": tokens.op6_token_output,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_neardup": simhash.op10_simhash_neardup,
    "op11_bpe_codec": bytepairs.op11_bpe_codec,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_sort_means": clusters.op13_sort_means,
}

ORACLES = {
    "op4_url_filter": urls.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op12_vector_codes": codes.ORACLE,
    "op13_sort_means": clusters.ORACLE,
}
