"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from textloom.llm import chat_format, chat_repair, decontamination, exact_dedup, importance, line_dedup, mixing, ngram_join, pii, repeat_removal, simhash_dedup, token_store, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_store": token_store.op3_token_store,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_repeat_removal": repeat_removal.op5_repeat_removal,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_personal_data": pii.op8_personal_data,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_importance_resample": importance.op11_importance_resample,
    "op12_chat_repair": chat_repair.op12_chat_repair,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_source_mix": mixing.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_importance_resample": importance.ORACLE_SQL,
    "op12_chat_repair": chat_repair.ORACLE_SQL,
    "op13_ngram_join": ngram_join.ORACLE_SQL,
}
