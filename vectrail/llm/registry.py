"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from vectrail.llm import ann, decontaminate, extract, oracles, pieces, repair, simhash, substring, suffix, toolcalls, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_learned_partitions": ann.op1_learned_partitions,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_line_blocks": extract.op3_line_blocks,
        "op4_repair_ids": repair.op4_repair_ids,
        "op5_suffix_repeats": suffix.op5_suffix_repeats,
        "op7_countmin_substrings": substring.op7_countmin_substrings,
        "op8_tool_call_linking": toolcalls.op8_tool_call_linking,
        "op10_gumbel_pieces": pieces.op10_gumbel_pieces,
        "op9_toxicity_kneser_ney": toxicity.op9_toxicity_kneser_ney,
        "op6_simhash_balls": simhash.op6_simhash_balls,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": oracles.DECONTAMINATE,
        "op7_countmin_substrings": oracles.SUBSTRINGS,
        "op8_tool_call_linking": toolcalls.ORACLE,
    }
