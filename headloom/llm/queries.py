"""The queries of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

from headloom.llm import ann, best_fit, exact_dedup, importance, licenses, mixing, near_dedup, packing, prefix_trie, quality, sharding, suffix_dedup, token_store


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_packing": packing.op2_packing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_sharding": sharding.op4_sharding,
        "op5_token_store": token_store.op5_token_store,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_quality": quality.op7_quality,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_nearest": ann.op9_nearest,
        "op10_licenses": licenses.op10_licenses,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_importance": importance.op12_importance,
        "op13_best_fit": best_fit.op13_best_fit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_near_dedup": near_dedup.ORACLE_SQL,
        "op10_licenses": licenses.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
        "op12_importance": importance.ORACLE_SQL,
    }
