"""Registered queries of the corpus operators and the SQL for those it can express."""

from __future__ import annotations

from campwatch.llm import (
    centroids,
    chat_format,
    exact_dedup,
    media,
    mixing,
    near_join,
    packing,
    quality,
    secret_scan,
    spelling,
    token_counts,
    toxicity,
    warc,
)

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_token_counts": token_counts.op3,
    "op4_warc_history": warc.op4,
    "op5_quality_resample": quality.op5,
    "op6_pack_sequences": packing.op6,
    "op7_audio_columns": media.op7,
    "op8_toxicity_chain": toxicity.op8,
    "op9_chat_format": chat_format.op9,
    "op10_ngram_jaccard": near_join.op10,
    "op11_secret_scan": secret_scan.op11,
    "op12_centroid_clusters": centroids.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_warc_history": warc.OP4_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op11_secret_scan": secret_scan.OP11_SQL,
    "op12_centroid_clusters": centroids.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
