"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import byte_bpe, chat, forest, jaccard, licenses, metric_search, packing, pii, token_files, toxicity

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_token_files": token_files.query,
    "op4_best_fit_packing": packing.query,
    "op5_personal_data": pii.query,
    "op6_metric_top_k": metric_search.query,
    "op7_embedding_forest": forest.query,
    "op8_toxicity": toxicity.query,
    "op9_chat_template": chat.query,
    "op10_jaccard_join": jaccard.query,
}

ORACLES = {"op1_license_scan": licenses.oracle(), "op6_metric_top_k": metric_search.ORACLE, "op7_embedding_forest": forest.ORACLE}
