"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from deskflow.llm import bpe, exact_dedup, language_id, media, mixing, ngram_join, quality, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op1_ngram_links": ngram_join.op1_ngram_links,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_files": token_files.op6_token_files,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_media_columns": media.op9_media_columns,
    "op10_token_counts": token_counts.op10_token_counts,
}

SQL = {
    "op1_ngram_join": ngram_join.SQL,
    "op1_ngram_links": ngram_join.LINKS_SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
}
