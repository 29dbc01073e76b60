"""The corpus queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from . import decontaminate, html_extraction, line_dedup, mixing, quality_rules, sharding, simhash, suffix_dedup, token_counts, url_filters


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_html_extraction": html_extraction.op2_html_extraction,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_url_filters": url_filters.op5_url_filters,
        "op3_mixing": mixing.op3_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash": simhash.op10_simhash,
        "op8_token_counts": token_counts.op8_token_counts,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "quality_ablation": quality_rules.quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op9_decontaminate": decontaminate.SQL, "op3_mixing": mixing.SQL, "op7_quality_rules": quality_rules.SQL,
            "quality_ablation": quality_rules.ABLATION_SQL}
