"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandloom.llm import best_fit, collocations, decontamination, filter_audit, language_id, license_scan, ngram_join, oracles, packed_matrix, pii, quality_rules, quotes, suffix_tree_lm, warc

QUERIES = {
    "op1_packed_matrix": packed_matrix.query,
    "op2_best_fit_packing": best_fit.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_suffix_tree_lm": suffix_tree_lm.query,
    "op5_quotation_linking": quotes.query,
    "op6_warc": warc.query,
    "op7_decontamination": decontamination.query,
    "op8_license_scan": license_scan.query,
    "op9_pii": pii.query,
    "op10_quality_rules": quality_rules.query,
    "op11_language_id": language_id.query,
    "op12_filter_audit": filter_audit.query,
    "op13_collocations": collocations.query,
}
ORACLE_SQL: dict[str, str] = oracles.SQL
