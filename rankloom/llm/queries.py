"""Registry of the corpus operators' queries and their DuckDB statements."""

from __future__ import annotations

from rankloom.llm import bin_completion as _13
from rankloom.llm import chat_format as _8
from rankloom.llm import decontaminate as _7
from rankloom.llm import exact_dedup as _1
from rankloom.llm import html_extract as _5
from rankloom.llm import language_id as _3
from rankloom.llm import packing as _2
from rankloom.llm import pii as _10
from rankloom.llm import prefix_trie as _12
from rankloom.llm import simhash as _9
from rankloom.llm import substring_dedup as _4
from rankloom.llm import toxicity as _6
from rankloom.llm import turn_repair as _11


def queries() -> dict:
    return {
        "op1_exact_dedup": _1.op1_exact_dedup,
        "op2_packing": _2.op2_packing,
        "op3_language_id": _3.op3_language_id,
        "op4_substring_dedup": _4.op4_substring_dedup,
        "op5_html_extract": _5.op5_html_extract,
        "op6_toxicity": _6.op6_toxicity,
        "op7_decontaminate": _7.op7_decontaminate,
        "op8_chat_format": _8.op8_chat_format,
        "op9_simhash_neardup": _9.op9_simhash_neardup,
        "op10_pii": _10.op10_pii,
        "op11_turn_repair": _11.op11_turn_repair,
        "op12_prefix_trie": _12.op12_prefix_trie,
        "op13_best_fit_packing": _13.op13_best_fit_packing,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": _1.OP1_SQL,
        "op4_substring_dedup": _4.OP4_SQL,
        "op8_chat_format": _8.OP8_SQL,
        "op11_turn_repair": _11.OP11_SQL,
        "op12_prefix_trie": _12.OP12_SQL,
    }
