"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    conversation_trie,
    exact_dedup,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    spelling,
    token_counts,
    toxicity,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_packing": packing.op1_hilbert_packing,
        "op2_boosted_url_filter": url_filter.op2_boosted_url_filter,
        "op3_boosted_candidates": pii.op3_boosted_candidates,
        "op4_whole_token_counts": token_counts.op4_whole_token_counts,
        "op5_ngram_likelihood_rules": quality_rules.op5_ngram_likelihood_rules,
        "op6_positive_unlabelled": quality_classifier.op6_positive_unlabelled,
        "op7_tiktoken_round_trip": byte_bpe.op7_tiktoken_round_trip,
        "op8_hyperminhash_components": near_dedup.op8_hyperminhash_components,
        "op9_hypergeometric_sharding": sharding.op9_hypergeometric_sharding,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_heavy_path_trie": conversation_trie.op11_heavy_path_trie,
        "op12_calibrated_toxicity": toxicity.op12_calibrated_toxicity,
        "op13_neighbourhood_variants": spelling.op13_neighbourhood_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.OP10_SQL, "op11_heavy_path_trie": conversation_trie.OP11_SQL, "op13_neighbourhood_variants": spelling.OP13_SQL}
