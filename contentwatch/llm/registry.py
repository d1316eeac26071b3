"""Registered queries of the corpus operators."""

from __future__ import annotations

from contentwatch.llm import alignment, bpe, brown, chat, decontaminate, langid, licenses, minhash, pii, resampling, simhash, substrings, token_counts


def queries() -> dict:
    return {
        "op1_minhash": minhash.query,
        "op2_chat": chat.query,
        "op3_brown": brown.query,
        "op4_licenses": licenses.query,
        "op5_langid": langid.query,
        "op6_token_counts": token_counts.query,
        "op7_substrings": substrings.query,
        "op8_simhash": simhash.query,
        "op9_decontaminate": decontaminate.query,
        "op10_byte_bpe": bpe.query,
        "op11_alignment": alignment.query,
        "op12_pii": pii.query,
        "op13_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE, "op4_licenses": licenses.ORACLE}
