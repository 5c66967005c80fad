"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, embeddups, langid, lines, ngram_join, packing, suffixes, topk, urls, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_url_reputation": urls.op2_url_reputation,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_language_id": langid.op6_language_id,
    "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
    "op8_embedding_near_dedup": embeddups.op8_embedding_near_dedup,
    "op9_warc_bundles": warc.op9_warc_bundles,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

#: Queries that SQL cannot express are held against brute force in tests instead.
ORACLES: dict[str, str] = {
    "op2_url_reputation": urls.SQL,
    "op5_exact_top_k": topk.SQL,
    "op8_embedding_near_dedup": embeddups.SQL,
    "op9_warc_bundles": warc.SQL,
}
