"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cleanlake.llm import (
    alignment,
    bpe,
    chat,
    decontamination,
    huffman,
    jaccard_join,
    language,
    line_dedup,
    packing,
    prefix_trie,
    quality,
    toxicity,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_token_ids": huffman.op2_token_ids,
        "op3_quality": quality.op3_quality,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_language": language.op5_language,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_packing": packing.op7_packing,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_chat_format": chat.op10_chat_format,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_bpe": bpe.op12_bpe,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op8_jaccard_join": jaccard_join.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
    }
