"""The registered queries of these operators and their check statements."""

from __future__ import annotations

from tollbook.llm import bpe, chat, decontaminate, jaccard, language, neardup, negatives, pieces, quality, sharding, token_counts, url_filters, whitening

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_embedding_neardup": neardup.op8_embedding_neardup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_sharding": sharding.op10_sharding,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_bpe": bpe.op12_bpe,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
