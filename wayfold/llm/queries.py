"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, chat, langid, lm, mixing, near_dups, packing, quality_cnn, quality_rules, spelling, warc, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": langid.op2_language_id,
    "op3_ann": ann.op3_ann,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_cnn": quality_cnn.op5_quality,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_order_minhash": near_dups.op7_near_dups,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_chat": chat.op9_chat,
    "op10_warc": warc.op10_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_spelling": spelling.op12_spelling,
    "op13_packing": packing.op13_packing,
}

SQL = {"op1_mixing": mixing.OP1_SQL, "op9_chat": chat.OP9_SQL, "op10_warc": warc.OP10_SQL}
