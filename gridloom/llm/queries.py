"""The registered queries of this folder, with their SQL where SQL can say the same."""
from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, fill_middle, fingerprints, html_text, lexical_search, licenses, near_dup, packing, pii, quality, substring_dedup, url_filter

QUERIES = {f.__name__: f for f in (
    licenses.op1_license_scan, substring_dedup.op2_substring_dedup, decontaminate.op3_decontamination, pii.op4_pii, quality.op5_quality_rules, url_filter.op6_url_filter,
    packing.op7_best_fit_packing, html_text.op8_html_extraction, chat.op9_chat_formatting, near_dup.op10_minhash_near_dup,
    lexical_search.op11_ranked_search, fill_middle.op12_fill_in_middle, fingerprints.op13_fingerprints)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op5_quality_rules": quality.OP5_SQL, "op6_url_filter": url_filter.op6_sql(), "op11_ranked_search": lexical_search.OP11_SQL,
           "op12_fill_in_middle": fill_middle.OP12_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
