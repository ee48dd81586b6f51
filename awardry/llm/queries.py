"""The training-data operators as queries, with their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, near_dup, order_minhash, periodic, pieces, preferences, quality, secrets, spelling, token_records, toxicity, url_filter, warc_revisits

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_token_records": token_records.op2_token_records,
    "op3_near_duplicates": near_dup.op3_near_duplicates,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_warc_revisits": warc_revisits.op5_warc_revisits,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_preference_pairs": preferences.op9_preference_pairs,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_order_minhash": order_minhash.op11_order_minhash,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

#: SQL can't express op2 (a tokenizer), op6 (a classifier) and op7 (a tokenizer). Tests hold op2 and op7 against
#: the libraries and op6 against fit and score in plain Python.
ORACLE_SQL = {
    "op1_secret_scans": secrets.ORACLE,
    "op3_near_duplicates": near_dup.ORACLE,
    "op4_url_filters": url_filter.ORACLE,
    "op5_warc_revisits": warc_revisits.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_preference_pairs": preferences.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_periodic_runs": periodic.ORACLE,
}
