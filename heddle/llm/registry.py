"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from heddle.llm import filter_audit, fingerprint, line_dedup, mixing, near_dedup, quality, secret_scan, sentencepiece_codec, token_counts, token_files, tool_chat, toxicity, vector_codes

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_tool_chat": tool_chat.op4_tool_chat,
    "op5_token_files": token_files.op5_token_files,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

SQL = {
    "op3_fingerprints": fingerprint.OP3_SQL,
    "op4_tool_chat": tool_chat.OP4_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_secret_scan": secret_scan.OP13_SQL,
}
