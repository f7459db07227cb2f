"""The query of each operator, by name, and SQL twins where SQL can express one."""

from __future__ import annotations

from quarrymill.llm import exact_dedup, minhash_dedup, packing, piece_bpe, quality, quotes, search, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_quality_classifier": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_quotation_linking": quotes.query,
    "op6_warc_revisits": warc.query,
    "op7_minhash_near_dedup": minhash_dedup.query,
    "op8_piece_encoding": piece_bpe.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_topk_search": search.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op6_warc_revisits": warc.SQL,
    "op7_minhash_near_dedup": minhash_dedup.SQL,
    "op10_topk_search": search.SQL,
}
