"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

from textloom.llm import chat, exact, importance, lm, mixing, neighbours, packing, periodic, quality, secrets, simhash, substring, token_files


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_simhash": simhash.op2_simhash,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_token_files": token_files.op4_token_files,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_chat_format": chat.op7_chat_format,
        "op8_lm_score": lm.op8_lm_score,
        "op9_mixing": mixing.op9_mixing,
        "op10_exact_dedup": exact.op10_exact_dedup,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_neighbours": neighbours.op12_neighbours,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring.OP3_SQL, "op7_chat_format": chat.OP7_SQL, "op10_exact_dedup": exact.OP10_SQL, "op13_importance": importance.OP13_SQL}
