"""The registered queries of this package and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from . import op1_itq, op2_toxicity, op3_tokens, op4_simhash, op5_pii, op6_packing, op7_bpe, op8_quality, op9_html, op10_secrets

QUERIES = {
    "op1_itq": op1_itq.op1_itq,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_tokens": op3_tokens.op3_tokens,
    "op4_simhash": op4_simhash.op4_simhash,
    "op5_pii": op5_pii.op5_pii,
    "op6_packing": op6_packing.op6_packing,
    "op7_bpe": op7_bpe.op7_bpe,
    "op8_quality": op8_quality.op8_quality,
    "op9_html": op9_html.op9_html,
    "op10_secrets": op10_secrets.op10_secrets,
}
ORACLES = {
    "op8_quality": op8_quality.SQL,
}
