"""Queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidalframe.llm import byte_bpe, chat, classifier, dual_tree, lexical, ngram_lm, packing, paragraph_sketch, quality_rules, simhash, token_store, topk, url_filter

QUERIES = {
    "op10_ngram_lm": ngram_lm.query,
    "op4_chat_windows": chat.query,
    "op8_url_filter": url_filter.query,
    "op7_top_k": topk.query,
    "op5_byte_bpe": byte_bpe.query,
    "op2_token_store": token_store.query,
    "op6_packing": packing.query,
    "op9_quality_classifier": classifier.query,
    "op1_quality_rules": quality_rules.query,
    "op3_simhash_near_dedup": simhash.query,
    "op11_ranked_search": lexical.query,
    "op12_dual_tree_kmeans": dual_tree.query,
    "op13_paragraph_sketch": paragraph_sketch.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_top_k": topk.SQL,
    "op11_ranked_search": lexical.SQL,
    "op12_dual_tree_kmeans": dual_tree.SQL,
}
