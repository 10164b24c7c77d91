"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audio, chat, decontaminate, html, jaccard, oracles, packing, pii, quality, sharding, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_audio_features": audio.op3_audio_features,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_sharding": sharding.op6_sharding,
    "op7_warc": warc.op7_warc,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {
    "op1_pii": oracles.PII,
    "op4_benchmark_decontamination": oracles.DECONTAMINATION,
    "op7_warc": oracles.WARC,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op10_ngram_jaccard_join": oracles.JACCARD,
}
