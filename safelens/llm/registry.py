"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from . import chat, decontaminate, lm_score, mixing, near_dup, neighbours, periodic, quality, secrets, sharding, url_filter, vector_codes, warc


def queries():
    return {
        "op1_character_ratio": url_filter.op1_character_ratio,
        "op2_latent_retrieval": decontaminate.op2_latent_retrieval,
        "op3_pareto_mixing": mixing.op3_pareto_mixing,
        "op4_hilbert_windows": neighbours.op4_hilbert_windows,
        "op5_preference_pairs": chat.op5_preference_pairs,
        "op6_multi_index_hamming": near_dup.op6_multi_index_hamming,
        "op7_jump_sharding": sharding.op7_jump_sharding,
        "op8_cross_entropy_difference": lm_score.op8_cross_entropy_difference,
        "op9_fourier_quality": quality.op9_fourier_quality,
        "op10_randomness_battery": secrets.op10_randomness_battery,
        "op11_all_lag_runs": periodic.op11_all_lag_runs,
        "op12_revisit_resolution": warc.op12_revisit_resolution,
        "op13_heap_lloyd": vector_codes.op13_heap_lloyd,
    }


def oracle_sql():
    return {
        "op3_pareto_mixing": mixing.ORACLE_SQL,
        "op5_preference_pairs": chat.ORACLE_SQL,
        "op6_multi_index_hamming": near_dup.ORACLE_SQL,
        "op11_all_lag_runs": periodic.ORACLE_SQL,
        "op12_revisit_resolution": warc.ORACLE_SQL,
        "op13_heap_lloyd": vector_codes.ORACLE_SQL,
    }
