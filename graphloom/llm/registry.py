"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import collocations, jaccard_join, line_dedup, maxscore, mixing, ngram_quality, packing, quality_rules, resampling, secrets, simhash, substring_dedup, url_filter


def queries() -> dict:
    return {
        "op1_ngram_quality": ngram_quality.op1_ngram_quality,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_exact_topk": maxscore.op6_exact_topk,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_entropy_mixing": mixing.op8_entropy_mixing,
        "op9_suffix_dedup": substring_dedup.op9_suffix_dedup,
        "op10_url_filters": url_filter.op10_url_filters,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_collocations": collocations.op12_collocations,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op6_exact_topk": maxscore.ORACLE_SQL,
        "op10_url_filters": url_filter.ORACLE_SQL,
        "op12_collocations": collocations.ORACLE_SQL,
        "op13_importance_resampling": resampling.ORACLE_SQL,
    }
