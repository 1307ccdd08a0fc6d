"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, katz, langid, packing, preferences, quality, simhash, substrings, warc

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_warc_zstd": warc.op2_warc_zstd,
    "op3_language_id": langid.op3_language_id,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_pu": quality.op6_quality_pu,
    "op7_document_fingerprints": fingerprint.op7_document_fingerprints,
    "op8_packing": packing.op8_packing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_preferences": preferences.op10_preferences,
}
ORACLES = {
    "op2_warc_zstd": warc.OP2_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op7_document_fingerprints": fingerprint.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_preferences": preferences.OP10_SQL,
}
