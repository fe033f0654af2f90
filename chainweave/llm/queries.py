"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainweave.llm import chat, collinear, decontaminate, language, mixing, ngram_join, pii, sharding, source_audit, spotsigs, suffix_dedup, suffix_tree_lm, token_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language": language.op3_language,
    "op4_suffix_tree": suffix_tree_lm.op4_suffix_tree,
    "op5_chat": chat.op5_chat,
    "op6_fingerprints": spotsigs.op6_fingerprints,
    "op7_passages": collinear.op7_passages,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_mix_plan": mixing.op9_mix_plan,
    "op10_shards": sharding.op10_shards,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_pii": pii.op12_pii,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_chat": chat.OP5_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op12_pii": pii.OP12_SQL,
}
