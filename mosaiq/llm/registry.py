"""The opN queries and their SQL, for the driver's contract."""

from __future__ import annotations

from . import decontaminate, exact_substrings, langid, pages, pii, secrets, sentencepieces, simhash, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html": pages.op2_html,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op4_topk": topk.op4_topk,
    "op5_language": langid.op5_language,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_secrets": secrets.op7_secrets,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_substrings": exact_substrings.op10_exact_substrings,
}

ORACLE_SQL = {
    "op4_topk": topk.OP4_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op7_secrets": secrets.OP7_SQL,
}
