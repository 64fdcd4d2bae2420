"""The operators' queries and, where SQL can say the same, their SQL."""

from stocktake.llm import bpe, exact_dedup, fm_dedup, line_dedup, packing, quality, simhash, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_fm_dedup": fm_dedup.op3_fm_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL = {
    "op1_topk": topk.OP1_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
