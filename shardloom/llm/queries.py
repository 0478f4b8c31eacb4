"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from shardloom.llm import balltree, decontaminate, domain_lm, jaccard, langid, pieces, pii, repeats, spelling, toxicity, training_order, whitening, windows

QUERIES = {
    "op1_training_order": training_order.query,
    "op2_decontaminate": decontaminate.query,
    "op3_toxicity": toxicity.query,
    "op4_langid": langid.query,
    "op5_jaccard": jaccard.query,
    "op6_topk": balltree.query,
    "op7_repeats": repeats.query,
    "op8_pii": pii.query,
    "op9_domain_lm": domain_lm.query,
    "op10_pieces": pieces.query,
    "op11_whitening": whitening.query,
    "op12_spelling": spelling.query,
    "op13_windows": windows.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op6_topk": balltree.ORACLE,
    "op7_repeats": repeats.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_windows": windows.ORACLE,
}
