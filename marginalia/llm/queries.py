"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, fill_middle, filter_audit, hidden_lm, line_dedup, near_dedup, nearest, quality, secrets, substring_dedup, token_files

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_nearest_neighbours": nearest.op4_nearest_neighbours,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_token_files": token_files.op9_token_files,
    "op10_bpe": bpe.op10_bpe,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_lm_score": hidden_lm.op12_lm_score,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
