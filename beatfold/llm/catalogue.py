"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from beatfold.llm import alignment, bpe, hard_negatives, language, media, near_dedup, packing, quality, secret_scan, substring_dedup, topk, toxicity, url_filter

QUERIES = {
    "op1_secrets": secret_scan.op1_secrets,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op3_media": media.op3_media,
    "op4_packing": packing.op4_packing,
    "op5_bpe": bpe.op5_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language": language.op7_language,
    "op8_topk": topk.op8_topk,
    "op9_toxicity": toxicity.op9_toxicity,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_quality": quality.op12_quality,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op8_topk": topk.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
