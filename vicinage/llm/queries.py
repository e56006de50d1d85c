"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, language_id, license_scan, minhash_dedup, quality_classifier, quality_rules, source_mixing, suffix_dedup, url_filter, warc

_ALL = {
    "op1_source_mixing": source_mixing,
    "op2_language_id": language_id,
    "op3_decontaminate": decontaminate,
    "op4_quality_rules": quality_rules,
    "op5_warc": warc,
    "op10_minhash_dedup": minhash_dedup,
    "op6_quality_classifier": quality_classifier,
    "op7_license_scan": license_scan,
    "op8_suffix_dedup": suffix_dedup,
    "op9_url_filter": url_filter,
}
QUERIES = {name: module.query for name, module in _ALL.items()}
SQL = {name: module.SQL for name, module in _ALL.items() if getattr(module, "SQL", None)}
