"""Operators for training-data pipelines; nothing else in the library imports them."""

from queuelens.llm import (
    chat_format,
    decontaminate,
    license_scan,
    merkle,
    mixing,
    near_dedup,
    paragraph_dedup,
    pii,
    quality_rules,
    sharding,
    suffix_repeats,
    token_orc,
    word_runs,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_host_quality": quality_rules.op2_host_quality,
    "op3_suffix_repeats": suffix_repeats.op3_suffix_repeats,
    "op4_chat_events": chat_format.op4_chat_events,
    "op5_boosted_pii": pii.op5_boosted_pii,
    "op6_paragraph_bands": paragraph_dedup.op6_paragraph_bands,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_setsketch_dedup": near_dedup.op8_setsketch_dedup,
    "op9_license_join": license_scan.op9_license_join,
    "op10_token_orc": token_orc.op10_token_orc,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ring_shards": sharding.op12_ring_shards,
    "op13_word_runs": word_runs.op13_word_runs,
    "mix_by_language": mixing.mix_by_language,
}

ORACLE = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_host_quality": quality_rules.ORACLE,
    "op4_chat_events": chat_format.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_ring_shards": sharding.ORACLE,
    "op13_word_runs": word_runs.ORACLE,
    "mix_by_language": mixing.ORACLE_BY_LANGUAGE,
}
