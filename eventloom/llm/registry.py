"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from eventloom.llm import exact_dedup, language, near_dedup, packing, pii, quality, secrets, sentencepiece_codec, token_counts, warc

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_language_id": language.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_minhash_near_dedup": near_dedup.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_pii": pii.query,
    "op7_best_fit_packing": packing.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_rules": quality.query,
    "op10_warc": warc.query,
}

ORACLES = {
    "op1_secret_scan": secrets.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_warc": warc.SQL,
}
