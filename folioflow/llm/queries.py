"""The operators' queries and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from . import decontam, html_text, packing, quality, secrets, sharding, simhash, token_count, token_output, toxicity

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_html_extraction": html_text.query,
    "op3_token_counts": token_count.query,
    "op4_simhash": simhash.query,
    "op5_best_fit_packing": packing.query,
    "op6_token_output": token_output.query,
    "op7_decontamination": decontam.query,
    "op10_secret_scans": secrets.query,
    "op9_toxicity": toxicity.query,
    "op8_sharding": sharding.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.oracle_sql(),
    "op7_decontamination": decontam.ORACLE_SQL,
}
