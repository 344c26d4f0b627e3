"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, dac, embed, langid, linededup, mixing, multiset, simhash, substring, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_mixing": mixing.op2_mixing,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_embedding_near_dups": embed.op5_embedding_near_dups,
        "op6_language": langid.op6_language,
        "op7_fingerprints": multiset.op7_fingerprints,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_files": dac.op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE_SQL,
        "op5_embedding_near_dups": embed.ORACLE_SQL,
    }
