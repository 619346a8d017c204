"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_codec, chat_format, decontamination, divergence, host_rules, jaccard_join, language_id, lm_scoring, merkle_manifest, mixing, pii, quality_classifier, token_files


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_host_rules": host_rules.op4_host_rules,
        "op5_language_id": language_id.op5_language_id,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_personal_data": pii.op8_personal_data,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_token_files": token_files.op10_token_files,
        "op11_bpe_codec": bpe_codec.op11_bpe_codec,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_host_rules": host_rules.OP4_SQL,
        "op6_chat_format": chat_format.OP6_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_merkle_manifest": merkle_manifest.OP13_SQL,
    }
