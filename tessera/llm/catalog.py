"""Queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from . import compact_windows, decontaminate, exact_dedup, hard_negatives, mixing, packing, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc

_MODULES = {
    "op1_pack": packing,
    "op2_token_counts": token_counts,
    "op3_compact_windows": compact_windows,
    "op4_url_filter": url_filter,
    "op5_decontaminate": decontaminate,
    "op6_warc": warc,
    "op7_toxicity": toxicity,
    "op8_simhash": simhash,
    "op9_exact_dedup": exact_dedup,
    "op10_suffix_dedup": suffix_dedup,
    "op11_hard_negatives": hard_negatives,
    "op12_mixing": mixing,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
