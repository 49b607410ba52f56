"""The queries of this folder, and SQL that gives the same rows where there is such."""

from __future__ import annotations

from . import chat, fingerprint, language, lm, mixing, neighbours, packing, sharding, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        lm.op1_lm_score, language.op2_language, chat.op3_chat, sharding.op4_sharding, mixing.op5_mixing,
        toxicity.op6_toxicity, neighbours.op7_neighbours, packing.op8_packing, fingerprint.op9_fingerprint, simhash.op10_simhash,
    )
}
ORACLES = {"op1_lm_score": lm.ORACLE}
