"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import conversation_repair, decontaminate, html_text, jaccard_join, katz, language_id, manifest, pii, quality_classifier, quality_rules, secrets, sentencepiece, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece.query,
    "op2_pii": pii.query,
    "op3_secret_scans": secrets.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_url_filter": url_filter.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_html_extraction": html_text.query,
    "op9_quality_rules": quality_rules.query,
    "op10_language_id": language_id.query,
    "op11_katz_scores": katz.query,
    "op12_merkle_manifest": manifest.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLES = {"op4_ngram_jaccard_join": jaccard_join.ORACLE, "op7_benchmark_decontamination": decontaminate.ORACLE, "op11_katz_scores": katz.ORACLE, "op12_merkle_manifest": manifest.ORACLE}
