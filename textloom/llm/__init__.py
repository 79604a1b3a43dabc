"""Operators of a training-data pipeline: each takes DataFrames and returns a DataFrame."""

from __future__ import annotations

from textloom.llm import decontaminate, filter_audit, jaccard_join, language_id, license_scan, line_dedup, merkle_manifest, packing, pii, quality_rules, secret_scan, substring_dedup, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_language_id": language_id.op6_language_id,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_pii": pii.op10_pii,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
