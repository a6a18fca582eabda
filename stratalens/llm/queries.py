"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from stratalens.llm import exact_dedup, langid, maxent_lm, mixing, sentencepiece_sampling, simhash, substring_dedup, token_counts, toxicity, vafile

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_lm_scores": maxent_lm.op3_lm_scores,
    "op4_top_k": vafile.op4_top_k,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_sentencepiece": sentencepiece_sampling.op9_sentencepiece,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_top_k": vafile.OP4_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
}
