"""The corpus operators' registered queries and their DuckDB oracles."""

from __future__ import annotations

from . import chroma_prints, context_tree, curve_packing, license_scan, line_dedup, ngram_join, piece_codec, quality_rules, substring_dedup, tag_paths


def queries() -> dict:
    return {
        "op1_curve_packing": curve_packing.op1_curve_packing,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_sentencepiece_codec": piece_codec.op5_sentencepiece_codec,
        "op6_context_tree_weighting": context_tree.op6_context_tree_weighting,
        "op7_chroma_fingerprints": chroma_prints.op7_chroma_fingerprints,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_tag_path_ratios": tag_paths.op9_tag_path_ratios,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.OP2_SQL,
        "op3_ngram_jaccard_join": ngram_join.OP3_SQL,
        "op4_quality_rules": quality_rules.OP4_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
    }
