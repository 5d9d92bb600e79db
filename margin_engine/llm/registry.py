"""Queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import conversation_repair, decontaminate, merkle, mixing, ngram_lm, odd_sketch, pii, quality_model, quality_rules, suffix_dedup, token_files, tool_calls, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_ngram_lm": ngram_lm.op2,
    "op3_quality_model": quality_model.op3,
    "op4_tool_calls": tool_calls.op4,
    "op5_pii": pii.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_mixing": mixing.op7,
    "op8_token_files": token_files.op8,
    "op9_odd_sketch": odd_sketch.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_url_filter": url_filter.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

ORACLE = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_odd_sketch": odd_sketch.OP9_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
