"""The queries of this subpackage, and SQL for those that SQL can express."""

from tallyforge.llm import bpe, exact_dedup, html_text, katz, mixing, pii, quality, simhash, token_counts, url_filter

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_text": html_text.op10_html_text,
}
ORACLE_SQL = {"op4_url_filter": url_filter.OP4_SQL, "op5_quality_rules": quality.OP5_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
