"""Registered queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import alignment, bytepairs, collocations, jaccard, mixing, ogg, packing, quality, repeats, reputation, rules, sharding, wordpieces

QUERIES = {
    "op1_mix_sources": mixing.mixed_documents,
    "op2_remove_repeats": repeats.deduplicated_documents,
    "op3_quality": quality.scored_documents,
    "op4_url_reputation": reputation.judged_pages,
    "op5_pack": packing.packed_documents,
    "op6_ogg": ogg.stored_documents,
    "op7_shards": sharding.sharded_documents,
    "op8_token_counts": wordpieces.counted_documents,
    "op9_risk_rules": rules.judged_documents,
    "op10_jaccard_groups": jaccard.grouped_documents,
    "op11_align_tokens": alignment.aligned_documents,
    "op12_collocations": collocations.mined_documents,
    "op13_byte_bpe": bytepairs.encoded_documents,
}

SQL = {
    "op1_mix_sources": mixing.MIXED_DOCUMENTS_SQL,
    "op4_url_reputation": reputation.JUDGED_PAGES_SQL,
    "op7_shards": sharding.SHARDED_DOCUMENTS_SQL,
    "op12_collocations": collocations.MINED_DOCUMENTS_SQL,
}
