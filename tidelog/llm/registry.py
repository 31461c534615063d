"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from tidelog.llm import bpe, byte_bpe, gif, jaccard, langid, licences, merkle, packing, pii, quality, repeats, secrets, shards

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_license_scan": licences.op3_license_scan,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_sharding": shards.op5_sharding,
    "op6_gif_media": gif.op6_gif_media,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_pii": pii.op9_pii,
    "op10_language_id": langid.op10_language_id,
    "op11_periodic_runs": repeats.op11_periodic_runs,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op3_license_scan": licences.ORACLE_SQL,
    "op5_sharding": shards.ORACLE_SQL,
    "op8_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
