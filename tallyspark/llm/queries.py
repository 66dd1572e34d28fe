"""The package's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tallyspark.llm import exact, jaccard, mixing, packing, quality, substring, topk, toxicity, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_topk_search": topk.op2_topk_search,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op2_topk_search": topk.SQL,
    "op3_jaccard_join": jaccard.SQL,
    "op4_substring_dedup": substring.SQL,
    "op5_url_filters": urlfilter.SQL,
    "op6_exact_dedup": exact.SQL,
    "op10_mixing": mixing.SQL,
}
