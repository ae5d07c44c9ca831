"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import divergence_audit, html_extract, jaccard_join, language_id, mixing, packing, quality_rules, secret_scan, sharding, substring_dedup, token_alignment, topk_search, url_filter

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_packing": packing.op5_packing,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_divergence_audit": divergence_audit.op11_divergence_audit,
    "op12_sharding": sharding.op12_sharding,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {
    "op1_topk_search": topk_search.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op6_secret_scan": secret_scan.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op11_divergence_audit": divergence_audit.ORACLE,
}
