"""The corpus queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from quire.llm import ann, centroids, chat, langid, lm, mixing, neardup, ngramjoin, packing, suffix, topk, toxicity, variants

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_top": topk.op2_exact_top,
    "op3_language": langid.op3_language,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_pack_sequences": packing.op5_pack_sequences,
    "op6_chat_perspectives": chat.op6_chat_perspectives,
    "op7_repeated_passages": suffix.op7_repeated_passages,
    "op8_language_model": lm.op8_language_model,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_nearest": ann.op10_nearest,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_ngram_join": ngramjoin.op12_ngram_join,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE = {
    "op2_exact_top": topk.ORACLE,
    "op6_chat_perspectives": chat.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op12_ngram_join": ngramjoin.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
