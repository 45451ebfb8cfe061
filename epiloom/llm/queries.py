"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import decontamination, filter_audit, fingerprints, html_extraction, line_dedup, lm_scoring, ngram_join, packing, periodic_runs, token_counts, toxicity, url_reputation, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_url_reputation": url_reputation.op7_url_reputation,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_warc": warc.op13_warc,
}
SQL = {
    "op6_line_dedup": line_dedup.SQL,
    "op7_url_reputation": url_reputation.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_lm_scoring": lm_scoring.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
    "op13_warc": warc.SQL,
}
