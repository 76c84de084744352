"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from siltstone.llm import chat, classifier, mixing, neardup, packing, pii, pipeline, rules, sharding, topk, warc

QUERIES = {
    "op1_minhash_neardup": neardup.query,
    "op2_quality_rules": rules.query,
    "op3_chat_format": chat.query,
    "op4_exact_topk": topk.query,
    "op5_mix_sources": mixing.query,
    "op6_shard_bytes": sharding.query,
    "op7_warc": warc.query,
    "op8_best_fit_packing": packing.query,
    "op9_quality_classifier": classifier.query,
    "op10_pseudonyms": pii.query,
    "pipeline": pipeline.query,
}
ORACLES = {"op3_chat_format": chat.ORACLE_SQL, "op4_exact_topk": topk.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL}
