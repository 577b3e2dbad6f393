"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from folioscope.llm import chat, decontaminate, exact, mixing, neardup, quality, sharding, tokens, toxicity, warc

_MODULES = {
    "op1_decontamination": decontaminate,
    "op2_toxicity": toxicity,
    "op3_source_mixing": mixing,
    "op4_exact_dedup": exact,
    "op5_quality": quality,
    "op6_warc": warc,
    "op7_order_minhash": neardup,
    "op8_sharding": sharding,
    "op9_token_counts": tokens,
    "op10_chat_formatting": chat,
}


def queries() -> dict[str, Callable]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if module.SQL}
