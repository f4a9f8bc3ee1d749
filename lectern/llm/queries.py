"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, context_mixing, embeddings, fim, html_wrapper, jaccard, line_chunks, mixing, pii, quality, sentencepiece_bpe, simhash, substrings

QUERIES = {
    "op1_sentencepiece": sentencepiece_bpe.op1_sentencepiece,
    "op2_simhash": simhash.op2_simhash,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op4_html_extraction": html_wrapper.op4_html_extraction,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_quality": quality.op6_quality,
    "op7_line_chunks": line_chunks.op7_line_chunks,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_delta_lloyd": centroids.op12_delta_lloyd,
    "op13_context_mixing": context_mixing.op13_context_mixing,
}
ORACLE_SQL = {
    "op3_embedding_near_dedup": embeddings.ORACLE_SQL,
    "op5_curriculum_mix": mixing.ORACLE_SQL,
    "op7_line_chunks": line_chunks.ORACLE_SQL,
    "op8_substring_dedup": substrings.ORACLE_SQL,
    "op9_pii": pii.ORACLE_SQL,
    "op10_ngram_jaccard": jaccard.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
    "op12_delta_lloyd": centroids.ORACLE_SQL,
}
