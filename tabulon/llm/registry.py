"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tabulon.llm import bpe, conversations, fingerprints, jaccard, katz, licenses, mixing, periodic, quality, store, suffixes, topk, toxicity


def queries() -> dict:
    found = [
        jaccard.op1_ngram_jaccard,
        quality.op2_quality,
        suffixes.op3_suffix_dedup,
        store.op4_token_store,
        katz.op5_katz,
        mixing.op6_mix,
        topk.op7_topk,
        bpe.op8_bpe,
        licenses.op9_licenses,
        fingerprints.op10_fingerprints,
        periodic.op11_periodic_runs,
        conversations.op12_conversations,
        toxicity.op13_toxicity,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can express the operator and is fast enough on whole tables."""
    return {"op9_licenses": licenses.ORACLE}
